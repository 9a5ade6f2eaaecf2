from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import langid
from pulsegrid.llm.wordbpe import default_vocabulary

from .data import documents, frame
from .test_duplicates import brute_lines
from .test_filters import best_windows, five

LANGS = {"en": "the of and to in that was with for this".split(), "fr": "le la les des une est dans pour que qui".split()}


def corpus(n=70):
    """Documents in two invented mixtures, copies and shared lines from ``documents``, benchmark passages, odd rows."""
    import random

    rng = random.Random(4)
    rows = []
    for d, text, _, source in documents(n=n):
        lang = rng.choice(sorted(LANGS))
        if text and d is not None and d % 6 not in (1, 2) and len(text) < 5000:
            text = " ".join(w + (" " + rng.choice(LANGS[lang]) if i % 4 == 3 else "") for i, w in enumerate(text.split(" ")))
        rows.append((d, text, lang if rng.random() < 0.8 else None, source))
    parts = [a + b for a in LANGS["en"] for b in LANGS["en"]]
    items = [(i, " ".join(rng.choice(parts) for _ in range(30))) for i in range(6)] + [(50, None), (51, "few words")]
    rows += [(500 + i, "some words before " + items[i][1] + " and some after", None, "src1") for i in range(6)]
    rows += [(600, "1234 %% 55", "en", None), (601, "中文 only", None, None)]
    return rows, items


def test_stages_by_brute_force(spark, tmp_path):
    rows, items = corpus()
    docs = frame(spark, rows, tmp_path / "documents.parquet").withColumn("n_chars", F.lit(0).cast("long"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns, at = docs.columns, {}
    key = lambda d: Counter((r.doc_id, r.text, r.lang, r.source) for r in d.collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        out = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if name != "bpe_encoding":
            assert out.columns == columns
            assert {r.id for r in out.collect()} == {"clash"}
        at[name] = (docs, out)
        docs = out

    before, after = at["language_id"]
    learned = langid.learn(before.filter(~langid.held_out("doc_id") & F.col("doc_id").isNotNull()))
    found = langid.predict(before, learned, extra=["doc_id", "text", "lang", "source"]).collect()
    assert key(after) == Counter(tuple(r.row) for r in found if r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_LANG_SCORE)
    assert before.count() > after.count()

    before, after = at["line_dedup"]
    own = [(r.doc_id, r.text, r.lang, r.source) for r in before.collect()]
    assert Counter((r.doc_id, r.text) for r in after.collect()) == Counter((d, t) for d, *_, t in brute_lines(own))
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = at["near_duplicates"]
    own = [(r.doc_id, r.text, r.lang, r.source) for r in before.collect()]
    sets: dict = {}
    for d, t, *_ in own:
        w = (t or "").lower().split()
        s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        if d is not None:
            sets[d] = sets.get(d, set()) | s
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if r == hi else r for k, r in root.items()}
    assert key(after) == Counter(r for r in own if r[0] is None or root[r[0]] == r[0]) and after.count() < before.count()

    before, after = at["decontamination"]
    own = [(r.doc_id, r.text, r.lang, r.source) for r in before.collect()]
    gone = {d for d, _ in best_windows([r[:2] for r in own], items)}
    assert key(after) == Counter(r for r in own if r[0] not in gone) and len(gone) >= 3
    assert all(five(x) for i, x in items if i < 50)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_vocabulary())
    before, after = at["bpe_encoding"]
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in before.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in after.collect()) == want and all(r.n_tokens == len(r.ids) for r in after.collect())


@pytest.mark.parametrize("items", [True, False])
def test_pipeline_over_empty_tables(spark, tmp_path, items):
    frame(spark, [], tmp_path / "documents.parquet", extra=False).withColumn("n_chars", F.lit(0).cast("long")).write.parquet(str(tmp_path / "d" / "documents.parquet"))
    spark.createDataFrame([(1, "a b c d e f g")] if items else [], "item_id long, text string").write.parquet(str(tmp_path / "d" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "d")).count() == 0


def test_stages_begin_by_giving_memory_back(spark, tmp_path, monkeypatch):
    docs = frame(spark, corpus()[0][:12], tmp_path / "documents.parquet", extra=False).withColumn("n_chars", F.lit(0).cast("long"))

    class Called(Exception):
        pass

    def called(_):
        raise Called

    monkeypatch.setattr(corpus_pipeline, "give_back", called)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Called):
            stage(spark, docs, str(tmp_path))
