"""The pipeline's stages, one after another, against plain versions of what they promise."""

import random

import corpus_pipeline
from callsight.llm import quality, staging

from .test_decontaminate import brute, items
from .test_dedup import UPPER, brute_near

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    rng = random.Random(21)
    bench = items(12)
    word = lambda: "".join(rng.choice(["an", "th", "er", "ou"]) for _ in range(rng.randrange(1, 4)))
    good = lambda: " ".join(word() for _ in range(rng.randrange(30, 90))).capitalize() + "."
    rows, labels = [], []
    for k in range(300):
        if k % 5 == 0:
            text, q = " ".join(f"{word().upper()}!!" for _ in range(60)), 0
        else:
            text, q = good(), 1
        rows.append((k, text))
        labels.append((k, q, 0))
    base = [t for i, t in rows if i % 5]
    rows += [(400 + k, base[k].upper() if k % 2 else base[k]) for k in range(30)]
    rows += [(500 + k, base[k + 40] + " extra") for k in range(30)]
    rows += [(600 + k, base[k + 80] + " " + bench[k % 12] + " " + good()) for k in range(20)]
    rows += [(700, None), (701, ""), (None, good()), (702, good())]
    rng.shuffle(rows)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, bench


def test_stages(spark, tmp_path):
    rows, bench = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now = {(i, t) for i, t in rows}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        before, docs = docs, staging.stage(out, f"t-{name}")
        got = {(r["doc_id"], r["text"]) for r in docs.collect()}
        if name == "quality":
            model = quality.train(before, spark.read.parquet(f"{tmp_path}/labels.parquet"))
            want = {(i, t) for i, t in now if model.score(quality.statistics(__import__("pyarrow").array([t], "string")).astype(float))[0] >= 0.3}
        elif name == "exact_dedup":
            best = {}
            for i, t in now:
                k = (t or "").translate(UPPER)
                if k not in best or (i is not None and (best[k][0] is None or i > best[k][0])):
                    best[k] = (i, t)
            want = set(best.values())
        elif name == "near_dedup":
            kept = {i for i, _, _, k in brute_near([(i, t) for i, t in now if i is not None], 80) if k}
            want = {(i, t) for i, t in now if i is None or i in kept}
        else:
            hit = {i for i, _ in brute(bench, [(i if i is not None else -1, t) for i, t in now])}
            want = {(i, t) for i, t in now if i not in hit}
        assert got == want and (name == "quality" or len(got) < len(now)), name
        now = got
    final = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in final} == {i for i, _ in now}
    cut = lambda out: sorted(str((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])) for r in out)
    assert cut(final) == cut(corpus_pipeline.run(spark, str(tmp_path)).collect())
