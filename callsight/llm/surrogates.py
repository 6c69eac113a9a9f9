"""Keyed surrogates for personal data.

Detected entities (e-mail and IP addresses, phone, card, account and social security numbers, titled
personal names, credentials) are replaced by values of the same type and format, drawn from an HMAC
of the secret key and the entity's canonical form. The same entity has the same surrogate wherever
it stands and however it is written (coreference: a phone number with or without separators, a
surname with or without given name, either case, with a title or, later and earlier in the same document,
without one); different entities have different ones.

Distinctness is checked over the whole corpus: surrogates that two entities share, or that equal any
entity of the corpus, are drawn again until none is left; a format with too few values grows longer with each
further draw, or gives up a fixed prefix. Redrawn entities reach the texts that hold them by a join; texts that a
filter of bounded size rules out are not shuffled.

Formats: digits stay digits and letters letters of their case and script; grouping, country prefix, card issuer
digit, check sums (Luhn, IBAN) and top-level domain stay; names keep script (Latin or Cyrillic), case,
title and gender: by title, else by another title of that name in the document, else by a list of given names, else
neutral. Persons without any title in their document are not found. A credential without a letter or digit (a mask
such as ``********``) is none, and neither is a plain word after ``secret:`` or ``token:``. Defined cases: null stays
null and counts no entity, empty and plain texts are unchanged; repeated rows and null ids are treated like others;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .probe import Probe
from .staging import stage
from .words import slices

_LATIN_TITLES = {"mr": "m", "mrs": "f", "ms": "f", "miss": "f", "herr": "m", "frau": "f", "monsieur": "m", "madame": "f",
                 "mme": "f", "señor": "m", "señora": "f", "dr": "", "prof": ""}
_CYRILLIC_TITLES = {"господин": "m", "госпожа": "f", "г-н": "m", "г-жа": "f"}
_TITLES = _LATIN_TITLES | _CYRILLIC_TITLES

# common given names by gender, for titles that tell none (fixed values)
_GIVEN = {name: sex for sex, names in {
    "f": """alice amy andrea angela anna anne barbara carla carmen carol caroline catherine charlotte christine clara claudia
    diana elena elizabeth ella emily emma eva hannah helen helga ingrid irene isabel jane janet jessica joan julia karen kate
    laura lisa lucy margaret maria marie martha mary monica nancy nicole olivia patricia paula rachel rebecca rosa ruth sandra
    sarah silvia sofia sophie susan teresa ursula victoria""",
    "m": """adam alan albert alexander andrew anthony antonio brian carlos charles chris christian christopher daniel david
    dieter donald edward eric felix francis frank fred george hans harry henry hugo ivan jack jacques james jean john joseph
    juan karl kevin klaus lewis louis luis marc mark martin matthew michael nicholas oliver oscar otto patrick paul pedro peter
    philip pierre ralph richard robert roger simon stefan stephen steven thomas timothy victor walter werner william""",
}.items() for name in names.split()}

_TITLE_WORDS = "|".join(form for t in _TITLES
                        for form in [t.capitalize(), t.upper()] + [t] * (t in _CYRILLIC_TITLES))
_NAME = rf"(?!(?:{_TITLE_WORDS})\b)" r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]*[^\W\d_]"
_PATTERNS = [
    ("credential", "=", re.compile(r"\bAKIA[0-9A-Z]{16}\b|\b(?:password|passwd|secret|token|api[_-]?key)\b\s*[=:]\s*[\"']?([^\s\"']{6,})", re.I)),
    ("email", "@", re.compile(r"[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("iban", "0", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", "0", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")),
    ("phone", "0", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4})(?!\d)")),
    ("card", "0", re.compile(r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)")),
    ("ssn", "0", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("person", "T", re.compile(rf"\b({_TITLE_WORDS})\b\.? ({_NAME}(?: {_NAME}){{0,2}})")),
]
_SAID = re.compile(r"(?:secret|token)\s*:\s*[^\"']", re.I)
_DIGIT, _TITLE = re.compile(r"\d{2}"), re.compile(rf"\b(?:{_TITLE_WORDS})\b")


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else int(d) * 2 - 9 * (d > "4") for k, d in enumerate(reversed(digits))) % 10 == 0


def _iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of all entities, without overlaps, earlier patterns first.

    A person is one entity for each name: its canonical form is gender, part and the name in lower case.
    """
    found: list[tuple[int, int, str, str]] = []
    persons: list[tuple[int, str, bool, str]] = []  # start, name, whether a surname, gender of the title
    taken: list[tuple[int, int]] = []
    digits, title = _DIGIT.search(text) is not None, None

    def free(a: int, b: int) -> bool:
        if any(a < y and x < b for x, y in taken):
            return False
        taken.append((a, b))
        return True

    for kind, need, pattern in _PATTERNS:
        if need == "0" and not digits or need == "@" and "@" not in text:
            continue
        if need == "=" and not ("=" in text or ":" in text or "AKIA" in text):
            continue
        if need == "T":
            title = title or _TITLE.search(text)
            if not title:
                continue
        for m in pattern.finditer(text):
            if kind == "credential":
                a, b = m.span(1) if m[1] else m.span()
                word = text[a:b].rstrip(".,;:!?")
                said = m[1] and word.isalpha() and word.islower() and _SAID.match(m[0])
                if not said and any(c.isalnum() for c in text[a:b]) and free(a, b):
                    found.append((a, b, kind, text[a:b]))
                continue
            a, b = m.span()
            plain = re.sub(r"[ .()+-]", "", m[0])
            if kind == "card" and not luhn(plain) or kind == "phone" and not 9 <= len(plain) <= 15 \
                    or kind == "iban" and (not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1):
                continue
            if kind == "person":
                names = list(re.finditer(_NAME, m[2]))
                if not free(*m.span(2)):
                    continue
                for k, n in enumerate(names):
                    name = n[0][:-2] if n[0][-2:] in ("'s", "’s") else n[0]
                    persons.append((m.start(2) + n.start(), name, k == len(names) - 1, _TITLES[m[1].lower()]))
            elif free(a, b):
                found.append((a, b, kind, m[0].lower() if kind == "email" else m[0] if kind == "ip" else plain))
    if persons:
        genders = {name.lower(): sex for _, name, last, sex in persons if sex and not last}
        canons: dict[str, str] = {}
        for at, name, last, sex in persons:
            low = name.lower()
            sex = "" if last else sex or genders.get(low) or _GIVEN.get(low, "n")
            canon = f"{sex}/{'surname' if last else 'given'}/{low}"
            found.append((at, at + len(name), "person", canon))
            for form in (name, name.upper(), name.capitalize()):
                canons.setdefault(form, canon)
        # the same names elsewhere in the document
        names = "|".join(re.escape(n) for n in sorted(canons, key=lambda n: (-len(n), n)))
        for m in re.finditer(rf"(?<!\w)(?:{names})(?!\w)", text):
            if free(*m.span()):
                found.append((*m.span(), "person", canons[m[0]]))
    return sorted(found)


class _Draw:
    """A stream of small numbers from the key and a label."""

    def __init__(self, key: bytes, label: str):
        self.key, self.label, self.block, self.data = key, label.encode("utf-8"), 0, b""

    def below(self, n: int) -> int:
        if len(self.data) < 4:
            self.data += hmac.new(self.key, self.label + b"#%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        out, self.data = int.from_bytes(self.data[:4], "big") % n, self.data[4:]
        return out

    def like(self, text: str) -> str:
        """Letters for letters of their case and script and digits for digits; the rest as it is."""
        return "".join(map(self._symbol, text))

    def _symbol(self, c: str) -> str:
        if "a" <= c <= "z":
            return chr(97 + self.below(26))
        if "A" <= c <= "Z":
            return chr(65 + self.below(26))
        if c.isdigit():
            zero = ord(c) - unicodedata.decimal(c) if c.isdecimal() else 48
            return chr(zero + self.below(10))
        if c.isalnum():
            letters = _letters_like(c)
            return letters[self.below(len(letters))]
        return c


# alphabets beyond Latin in common use (fixed values)
_ALPHABETS = ["абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνοπρστυφχψω"]


@lru_cache(maxsize=1 << 14)
def _letters_like(c: str) -> str:
    """Letters that may stand for one beyond ASCII: its alphabet in its case, else those of its kind and case in its
    block of 64 code points."""
    for letters in _ALPHABETS:
        if c.lower() in letters:
            return letters if c.islower() else letters.upper()
    first, kind = ord(c) & ~63, unicodedata.category(c)
    near = [x for x in map(chr, range(first, first + 64)) if unicodedata.category(x) == kind and x.isalnum()
            and (kind not in ("Ll", "Lu") or len(x.upper()) == 1 and x.upper() != x.lower() and x in (x.upper().lower(), x.lower().upper()))]
    return "".join(near) if len(near) > 1 else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_SYLLABLES = {
    "latin": (["b", "d", "f", "g", "k", "l", "m", "n", "r", "s", "t", "v"], ["a", "e", "i", "o", "u"], "a", "n", ["er", "ner", "ton", "sen"]),
    "cyrillic": (["б", "д", "г", "к", "л", "м", "н", "р", "с", "т", "в"], ["а", "е", "и", "о", "у"], "а", "н", ["ко", "юк", "ич"]),
}


def _person(draw: _Draw, canon: str, attempt: int) -> str:
    sex, part, name = canon.split("/", 2)
    consonants, vowels, female, male, ends = _SYLLABLES["cyrillic" if re.search("[а-яё]", name) else "latin"]
    stem = "".join(consonants[draw.below(len(consonants))] + vowels[draw.below(len(vowels))] for _ in range(3 + attempt // 4))
    if part == "surname":
        return stem + consonants[draw.below(len(consonants))] + ends[draw.below(len(ends))]
    if sex == "m":
        return stem + male
    return stem + consonants[draw.below(len(consonants))] + (female if sex == "f" else vowels[1])


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical form of an entity's surrogate."""
    draw = _Draw(key, f"{kind}|{canon}|{attempt}")
    if kind == "email":
        local, domain = canon.split("@", 1)
        name, tld = domain.rsplit(".", 1)
        local = draw.like(local + "x" * (attempt // 8))  # longer where the format has too few values
        return f"{local}@{_Draw(key, f'domain|{domain}').like(name)}.{tld}"
    if kind == "ip":
        return f"{1 + draw.below(223)}.{draw.below(256)}.{draw.below(256)}.{1 + draw.below(254)}"
    if kind == "person":
        return "/".join([*canon.split("/", 2)[:2], _person(draw, canon, attempt)])
    if kind == "card":
        body = canon[0] + draw.like(canon[1:-1])
        return next(body + d for d in "0123456789" if luhn(body + d))
    if kind == "iban":
        body = draw.like(canon[4:])
        return f"{canon[:2]}{98 - _iban_rest(f'{canon[:2]}00{body}'):02d}{body}"
    if kind == "phone":
        code = 0 if attempt >= 16 else 1 if canon[0] in "17" else 2  # far more numbers than a prefix has
        return canon[:code] + draw.like(canon[code:])
    if kind == "credential" and canon.startswith("AKIA"):
        return "AKIA" + draw.like(canon[4:])
    return draw.like(canon + "x" * (attempt // 8 if kind == "credential" else 0))


def written(kind: str, canon: str, original: str, value: str) -> str:
    """A surrogate's canonical form in the format of the entity as it stands in the text."""
    if kind == "person":
        name = value.split("/", 2)[2]
        return name.upper() if len(original) > 1 and original.isupper() else name.capitalize()
    if kind in ("phone", "card", "iban", "ssn"):
        symbols = iter(value)
        return "".join(next(symbols) if c.isalnum() else c for c in original)
    if kind == "email":
        return "".join(v.upper() if o.isupper() else v for o, v in zip(original.ljust(len(value)), value))
    return value


def _mentions(batches):
    """(text, kind, canon): the different entities of each text. Rows: text's hash, text."""
    for batch in batches:
        for first, column in slices(batch.column(1)):
            keys = batch.column(0).slice(first, len(column)).to_pylist()
            out = {(key, kind, canon) for key, text in zip(keys, column.to_pylist()) if text for _, _, kind, canon in find(text)}
            rows, kinds, canons = zip(*out) if out else ((), (), ())
            yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(kinds, pa.string()), pa.array(canons, pa.string())], ["key", "kind", "canon"])


def _draws(key: bytes):
    @F.arrow_udf("string")
    def run(kind: pa.Array, canon: pa.Array, attempt: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, *row) for row in zip(kind.to_pylist(), canon.to_pylist(), attempt.to_pylist())], pa.string())

    return run


def mentions(docs: DataFrame) -> DataFrame:
    """key (a hash of the text), kind and canon of every entity of every different text. A written table."""
    keyed = docs.where("text is not null").select(F.xxhash64("text").alias("key"), "text")
    return stage(keyed.mapInArrow(_mentions, "key long, kind string, canon string"), "pii-mentions")


def redrawn(found: DataFrame, key: bytes) -> DataFrame:
    """Entities of ``mentions`` whose surrogate is not their first draw: kind, canon, attempt. A written table."""
    entities = stage(found.select("kind", "canon").distinct(), "pii-entities")
    draw = _draws(key)
    now = stage(entities.withColumn("attempt", F.lit(0)).withColumn("value", draw("kind", "canon", "attempt")), "pii-draws")
    real = entities.select("kind", F.col("canon").alias("value"))
    while True:  # each draw of a narrow format has more values than the last
        rank = F.row_number().over(Window.partitionBy("kind", "value").orderBy(F.col("attempt").desc(), "canon"))
        marked = now.withColumn("n", rank).join(real.withColumn("real", F.lit(True)), ["kind", "value"], "left")
        clash = (F.col("n") > 1) | F.col("real").isNotNull()
        losers = stage(marked.where(clash).select("kind", "canon", F.col("attempt") + 1), "pii-clashes").toDF("kind", "canon", "attempt")
        if losers.isEmpty():
            return now.where("attempt > 0").select("kind", "canon", "attempt")
        drawn = losers.withColumn("value", draw("kind", "canon", "attempt"))
        kept = now.join(losers.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon", "attempt", "value")
        now = stage(kept.unionByName(drawn), "pii-draws")


def _rewrite(text: str, key: bytes, attempts: dict) -> tuple[str, int]:
    found = find(text)
    if not found:
        return text, 0
    out, at = [], 0
    for a, b, kind, canon in found:
        value = surrogate(key, kind, canon, attempts.get((kind, canon), 0))
        out += [text[at:a], written(kind, canon, text[a:b], value)]
        at = b
    return "".join([*out, text[at:]]), len(found)


def _rewritten(key: bytes):
    def run(batches):
        """doc_id, text, n_entities and changed of rows (key, doc_id, text) and, where given, redrawn entities."""
        for batch in batches:
            for first, column in slices(batch.column(2)):
                some = batch.slice(first, len(column))
                again = some.column(3).to_pylist() if batch.num_columns > 3 else [None] * len(column)
                out, counts, changed = [], [], []
                for text, more in zip(column.to_pylist(), again):
                    new, n = _rewrite(text, key, {(m["kind"], m["canon"]): m["attempt"] for m in more or ()}) if text else (text, 0)
                    out.append(new)
                    counts.append(n)
                    changed.append(new != text)
                yield pa.record_batch([some.column(1), pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(changed, pa.bool_())],
                                      ["doc_id", "text", "n_entities", "changed"])

    return run


def replace(docs: DataFrame, key: bytes | str) -> DataFrame:
    """doc_id, text with surrogates, n_entities (mentions replaced) and changed of every document."""
    key = key.encode("utf-8") if isinstance(key, str) else key
    kind, run = "doc_id long, text string, n_entities long, changed boolean", _rewritten(key)
    found = mentions(docs)
    again = (found.distinct().join(redrawn(found, key), ["kind", "canon"])
             .groupBy("key").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("again")))
    again = stage(again, "pii-again")
    texts = docs.select(F.xxhash64("text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    probe = Probe(again.select("key"))
    clear = probe.keep(False)
    doubtful = texts.mapInArrow(probe.keep(True), texts.schema).join(again, "key", "left").select("key", "doc_id", "text", "again")
    return texts.mapInArrow(lambda batches: run(clear(batches)), kind).union(doubtful.mapInArrow(run, kind))
