"""Column -> Column text helpers (all JVM-side, codegen friendly).

Every helper takes and returns :class:`pyspark.sql.Column` so it can be used in
``select``/``withColumn``/``filter`` and composed freely; nothing here runs
Python per row.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (token pattern, negation words and window must equal the reference) ---
TOKEN_PATTERN = "[a-zA-Z][a-zA-Z0-9'_-]*"
NEGATION_WORDS = ["no", "not", "never", "without", "deny", "denied", "denies"]
NEGATION_WINDOW = 20
TAIL_FRACTION_DEFAULT = 0.25
# --- end fixed values ---

# Whitespace as Python's str.isspace() sees it, spelled so Java and RE2 read it alike.
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"

# A text that is more than white space.
NOT_BLANK = "[^" + WS_CLASS[1:]

# Unicode-aware word boundary written with explicit classes so that Java and RE2
# agree (Python's ``\b`` treats letters/digits/underscore of any script as word chars).
_NOT_WORD = r"[^\p{L}\p{N}_]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def negation_regex(words: Sequence[str] = NEGATION_WORDS) -> str:
    alt = "|".join(w for w in words)
    return f"(^|{_NOT_WORD})({alt})({_NOT_WORD}|$)"


def safe_text(c) -> Column:
    """null -> '' (the reference treats missing transcripts as empty)."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def tokens(c) -> Column:
    """ASCII word tokens; null text gives an empty array."""
    return F.regexp_extract_all(safe_text(c), F.lit(TOKEN_PATTERN), 0)


def token_count(c) -> Column:
    """Number of tokens (null -> 0)."""
    return F.size(tokens(c))



def contains_any(text_lc, phrases: Iterable[str]) -> Column:
    """Any non-blank phrase occurs in the (already lower-cased) text."""
    cond = F.lit(False)
    for p in phrases:
        p = str(p).lower()
        if p:
            cond = cond | (F.instr(_col(text_lc), p) > 0)
    return cond


def negation_guard(text_lc, phrase: str, words: Sequence[str] = NEGATION_WORDS,
                   window: int = NEGATION_WINDOW) -> Column:
    """T4: phrase occurs and no negation word sits in the ``window`` characters
    before its first occurrence (window ends right before the phrase)."""
    phrase = str(phrase).lower()
    if not phrase:
        return F.lit(False)
    t = _col(text_lc)
    pos = F.instr(t, phrase)
    start = F.greatest(F.lit(1), pos - window)
    win = t.substr(start, pos - start)
    return (pos > 0) & ~F.coalesce(win.rlike(negation_regex(words)), F.lit(False))


def tail_tokens(tok_array, frac: float = TAIL_FRACTION_DEFAULT) -> Column:
    """Last ``frac`` of a token array: tokens[int(n*(1-frac)):]."""
    frac = max(0.0, min(1.0, float(frac or TAIL_FRACTION_DEFAULT)))
    arr = _col(tok_array)
    n = F.size(arr)
    start = F.floor(n * F.lit(1.0 - frac)).cast("int")
    return F.slice(arr, start + 1, n - start)


def tail_text(c, frac: float = TAIL_FRACTION_DEFAULT) -> Column:
    """T5: last fraction of tokens joined by one space."""
    return F.array_join(tail_tokens(tokens(c), frac), " ")


def unicode_trim(c) -> Column:
    """Strip Unicode whitespace at both ends (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(_col(c), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def trimmed(c: Column) -> Column:
    """``unicode_trim`` of a long text in a column: searched only if it begins or ends with white space."""
    at_end = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1)).rlike(WS_CLASS)
    return F.when(at_end, unicode_trim(c)).otherwise(c)


def normalize_ws(c) -> Column:
    """Collapse any whitespace run to one space and strip (null -> '')."""
    return unicode_trim(F.regexp_replace(safe_text(c), f"{WS_CLASS}+", " "))


def norm_key(c) -> Column:
    """Strip + lower, the key used for case/space-insensitive equality."""
    return F.lower(unicode_trim(_col(c).cast("string")))


def str_or_empty(c) -> Column:
    """Null -> '' string coercion."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def sha256_hex(c) -> Column:
    """sha256 hex digest of the UTF-8 text."""
    return F.sha2(_col(c).cast("string"), 256)


def key_from_parts(*parts) -> Column:
    """sha256 of the parts joined by two pipe characters."""
    return F.sha2(F.concat_ws("||", *[_col(p).cast("string") for p in parts]), 256)


def mask_name(c) -> Column:
    """Each whitespace-separated part -> first char + '*' * (len-1); one-char part -> char + '*';
    null or blank input is returned unchanged."""
    raw = _col(c)
    parts = F.split(unicode_trim(raw), f"{WS_CLASS}+")
    masked = F.array_join(
        F.transform(parts, lambda p: F.when(F.length(p) <= 1, F.concat(p, F.lit("*")))
                    .otherwise(F.concat(F.substring(p, 1, 1), F.repeat(F.lit("*"), F.length(p) - 1)))),
        " ")
    blank = raw.isNull() | (unicode_trim(raw) == "")
    return F.when(blank, raw).otherwise(masked)


def local_date(ts, tz: str) -> Column:
    """UTC timestamp -> calendar date in ``tz``."""
    return F.to_date(F.from_utc_timestamp(_col(ts), tz))
