"""Unigram encoding against the sentencepiece library on a unigram model, and round trips."""

import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
import public_tokenizers  # noqa: E402
from sentencepiece import sentencepiece_model_pb2 as pb  # noqa: E402

from roadlake.llm import unigram  # noqa: E402

PARTS = ["the", "a", " ", "  ", "\n", "漢字", "é", "🙂", "ing", "xx", "tion", " of", "ꙮ"]


@pytest.fixture(scope="module")
def models(tmp_path_factory):
    """The pieces of the public model with random log scores, as a unigram model: the library's and ours."""
    rng, m = random.Random(3), pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.type == 1:
            p.score = -rng.uniform(4, 14)
    path = tmp_path_factory.mktemp("m") / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return sentencepiece.SentencePieceProcessor(model_file=str(path)), unigram.Unigram.from_model(str(path)), str(path)


def test_equals_the_library(models):
    library, own, _ = models
    rng = random.Random(4)
    for _ in range(600):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))
        assert own.encode(text) == library.encode(text), text
        assert own.decode(own.encode(text)) == text


def test_walk_equals_array_passes(models, monkeypatch):
    own, rng = models[1], random.Random(5)
    texts = [unigram.MARK + "".join(rng.choice([p for p in PARTS if " " not in p]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    walked = [own.encode_segments([t])[0] for t in texts]
    monkeypatch.setattr(unigram, "FEW", 0)
    assert own.encode_segments(texts) == walked


def test_long_text_without_blanks(models):
    library, own, _ = models
    rng = random.Random(6)
    text = "".join(rng.choice([p for p in PARTS if " " not in p]) for _ in range(60_000))
    ids = own.encode(text)
    assert own.decode(ids) == text
    assert ids == library.encode(text)


def test_best_score_is_brute_forces():
    pieces = [("▁", -3.0, 0), ("a", -2.0, 1), ("b", -2.5, 2), ("ab", -4.0, 3), ("▁a", -4.5, 4), ("bb", -4.9, 5), ("abb", -6.4, 6)]
    own, score = unigram.Unigram(pieces, {}, 9), {p: s for p, s, _ in pieces}

    def best(text):
        return max((score[text[:n]] + best(text[n:]) for n in range(1, len(text) + 1) if text[:n] in score), default=-1e9) if text else 0.0

    for text in ("ab", "abb", "abbab", "aabbb", "bababba"):
        by_id = {i: s for _, s, i in pieces}
        assert sum(by_id[i] for i in own.encode(text)) == pytest.approx(best("▁" + text))


def test_rows(spark, models):
    rows = [(1, "the thing of 漢字ꙮ"), (2, None), (3, ""), (3, ""), (4, " ".join(["xx the"] * 3000)), (5, "x" * 5000)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n_pieces string")
    got = unigram.encode(df, models[2]).collect()
    assert all(r.decodes for r in got) and sorted(r.doc_id for r in got) == [1, 2, 3, 3, 4, 5]
    assert {r.doc_id: r.n_pieces for r in got}[2] == 0
    back = unigram.decode(unigram.encode(df, models[2]), models[2]).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i, t or "") for i, t in rows)
    assert unigram.encode(df.limit(0), models[2]).count() == 0


def test_query_returns_ids(spark, tmp_path):
    import public_tokenizers

    from roadlake.llm import queries

    spark.createDataFrame([(1, "the thing of 漢字ꙮ"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_unigram(spark, str(tmp_path))
    back = unigram.decode(got, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id, r.text) for r in back) == [(1, "the thing of 漢字ꙮ"), (2, "")]
