import random

import pytest

spm = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")

from roomscope.llm import pieces  # noqa: E402


@pytest.fixture(scope="module")
def both():
    path = P.path("piece_bpe_32k.model")
    return spm.SentencePieceProcessor(model_file=path), pieces.PieceModel.load(path, memo=50)


TEXTS = ["", " ", "  a\n\tb", "a▁b", "Ünï <s> <0x41> é\0x", "  lead", "trail  ", "ﬁ ① Å", "▁▁x", "\n\n \n a", "x" * 5000, "😀 日本語 テスト", "a b　c", "▁", " ▁ ▁"]


def test_equals_library(both):
    sp, m = both
    random.seed(3)
    texts = TEXTS + ["".join(random.choice(" \n▁aé日😀thein,.!\t") for _ in range(random.randrange(40))) for _ in range(300)]
    for t in texts:
        ids = sp.encode(t)
        got, joined, back, end = m.digest(t)
        assert joined == ",".join(map(str, ids)) and got.tolist() == ids
        assert back == sp.decode(ids) == m.decode(ids)
        own, begin, end2 = m.encode(t)
        assert own == ids and list(end) == list(end2)
        assert all(a <= b for a, b in zip(begin, end2, strict=True)) and (not len(end2) or end2[-1] == len(t.encode()))


def test_what_decodes_to_itself_is_not_decoded(both):
    sp, m = both
    random.seed(8)
    for n in [1, 2, 3, 5, 20, 60] * 40:
        t = "".join(random.choice(" \nthe,aé日本😀\U000f0000\u0378\t\0") for _ in range(n))
        ids, joined, back, end = m.digest(t)
        own, _, want = m.encode(t)
        assert back is t and ids.tolist() == own == sp.encode(t) and sp.decode(own) == t
        assert joined == ",".join(map(str, own)) and end.tolist() == want.tolist()


def test_memo_keeps_what_it_met_first():
    m = pieces.PieceModel.load(P.path("piece_bpe_32k.model"), memo=40)
    m.digest("the of " + " ".join(f"x{i}" for i in range(200)))
    assert " the" in m._memo and " of" in m._memo and len(m._memo) <= 40
    m._memo.shrink()
    assert " the" in m._memo and len(m._memo) == 10


def test_spans_give_surfaces(both):
    _, m = both
    t = "Hello  wörld and more"
    ids, begin, end = m.encode(t)
    raw = t.encode()
    for k, a, b in zip(ids, begin, end, strict=True):
        if m.types[k] == pieces.NORMAL:
            assert m.pieces[k].replace("▁", " ").lstrip() == raw[a:b].decode().lstrip()


def test_character_map_against_library():
    norm = spm.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = dict(pieces._fields(dict(pieces._fields(norm.serialized_model_proto()))[3]))
    m = object.__new__(pieces.PieceModel)
    m.map, m.user, m.dummy, m.squeeze, m.escape = pieces.CharMap(spec[2]), [], True, True, True
    for t in ["ﬁ①Å ｶﾞ ｱ́", "가 ½ ™", " a  b ", "", "　x y ", "日本 語"]:
        assert m.normalise(t)[0] == norm.normalize(t)


def test_rows_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "Hello world", "x"), (1, "Hello world", "y"), (2, None, None), (None, "", "z")], "doc_id long, text string, n_tokens string")
    got = pieces.piece_digests(docs, P.path("piece_bpe_32k.model")).collect()
    assert len(got) == 4 and sorted(r.n_tokens for r in got) == [0, 0, 2, 2]
    assert sorted(len(r.ids) for r in pieces.piece_digests(docs, P.path("piece_bpe_32k.model"), with_ids=True).collect()) == [0, 0, 2, 2]
    assert pieces.piece_digests(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0
    full = pieces.encode_pieces(docs, P.path("piece_bpe_32k.model")).collect()
    assert [r.decoded for r in full if r.doc_id == 1] == ["Hello world"] * 2
