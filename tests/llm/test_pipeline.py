import random

import pytest

P = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")

from tests.llm.test_jaccard import brute as groups  # noqa: E402
from tests.llm.test_simple_ops import brute_hits  # noqa: E402
from tests.llm.test_suffixes import brute as passages  # noqa: E402


def test_pipeline_against_brute(spark, tmp_path):
    import hashlib

    import corpus_pipeline

    random.seed(6)
    vocab = "the of and into mild water stone bread road hill under over green".split() + [f"w{i}" for i in range(200)]
    text = lambda n: " ".join(random.choices(vocab, k=n)) + "."
    good = [text(random.randrange(20, 120)) for _ in range(60)]
    item, passage = text(14), text(60)
    good += [good[3], good[4][:-1] + " end.", text(30) + " " + item + " " + text(30), text(30) + " " + passage, text(20) + " " + passage + " " + text(9), item]
    bad = [" ".join(w.upper() + "!!" for w in random.choices(vocab, k=40)) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good + bad)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id: r.text for r in corpus_pipeline.good_quality(spark, docs, str(tmp_path)).collect()}
    assert set(kept) >= set(range(len(good))) - {len(good) - 1} and len(set(kept) - set(range(len(good)))) <= 2
    now = sorted(kept.items())
    now = [(k, t) for k, t in now if k == {a: c for a, _, c in groups(now, 5, 80)}[k]]
    cut = []
    for k, t in now:
        whole = [x for x in now if x[0] <= k]
        seen, raw = set(), t.encode()
        for j, u in whole[:-1]:
            seen |= {u.encode()[p : p + 100] for p in range(len(u.encode()) - 99)}
        gone = set()
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone.update(range(p, p + 100))
            seen.add(raw[p : p + 100])
        left = bytes(b for p, b in enumerate(raw) if p not in gone).decode(errors="ignore")
        if not gone or left.strip():
            cut.append((k, left))
    assert passages(now, 100)
    want = {}
    sp = spm.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for k, t in cut:
        n, hit, _ = brute_hits(t.encode(), [("0", item.encode())])
        if hit * 2 > n:
            continue
        if not hit:
            want[k] = hashlib.sha256(",".join(map(str, sp.encode(t))).encode()).hexdigest()
        else:
            want[k] = None
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(v is None or got[k] == v for k, v in want.items())


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, a repeated id, clashing column names, and no rows at all."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, block int, row string, shard double"
    whole = "a plain text of mild words that tells of water and stone, and of bread on the road over the hill. "
    rows = [(1, whole, None, None, None, 1, "x", 0.5), (1, whole, "en", "s", 4, 2, None, None), (2, None, "en", "s", None, 3, "y", 1.0), (3, "", None, "s", 0, 4, "z", 2.0), (None, "only " + whole, "en", None, 9, 5, "w", 3.0), (4, whole * 3000, "en", "s", 1, 6, "v", 4.0)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (7, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, kind)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    left = {(r.doc_id, r.block): r.text for r in now.collect()}
    # The rows of id 1 link with no smaller id and stay; one of them, the long one and the one without an id lose what was there before.
    assert left[2, 3] is None and left[3, 4] == "" and (1, 1) in left
    for n, d in ((len(rows), docs), (0, docs.limit(0))):
        path = tmp_path / f"t{n}"
        path.mkdir()
        d.write.parquet(f"{path}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
        out = corpus_pipeline.run(spark, str(path))
        assert out.count() == (len(left) if n else 0)
