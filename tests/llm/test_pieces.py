"""SentencePiece encoding by the agenda against the library, on awkward texts and on a whole table."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from inkspan.llm import pieces

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
TEXTS = [
    "", "a", " ", "  ", "a b", "a  b", " a", "a ", "   a   b  ", "▁", "▁x▁▁y", "a\nb", "\n\n", "a\x00b", "日本語 テキスト", "<s> </s> <unk> <0x0A>", "x" * 5000,
    "ab" * 3000 + " " * 40, "é́ ﬁ", "😀😀 😀", "\t tab", "a\u3000b ", " " * 17 + "z", "नमस्ते दुनिया", "end. Next,one (two) three's", "word " * 20000,
]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def wanted(t):
    ids = LIBRARY.encode(t or "", add_eos=True)
    return len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids))


def test_agenda_is_exact():
    enc = pieces.PieceEncoder(pieces.default_model(), max_units=50)  # forgets all the time
    for k in range(3):
        ids, at, agrees = enc.encode(pa.array(TEXTS[k:]))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [LIBRARY.encode(t) for t in TEXTS[k:]] and agrees.all()


def test_heap_and_matrix_agree():
    """Long units have a heap, short ones are rows of a matrix."""
    v = pieces.MergeVocabulary(pieces.default_model())
    rng = np.random.default_rng(1)
    units = ["▁" + "".join(rng.choice(list("aeinrst.,▁ñ日"), int(rng.integers(1, 31)))) for _ in range(3000)]
    ids, n = v.agendas(units)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [v.agenda(u) for u in units]


def test_a_wrong_unit_is_seen(monkeypatch):
    enc = pieces.PieceEncoder(pieces.default_model())
    enc.vocabulary.pair_rank[:] = pieces._NO_PAIR  # no merges at all
    _, _, agrees = enc.encode(pa.array(["x", "hello there", None]))
    assert agrees.tolist() == [False, False, True]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(LIBRARY.serialized_model_proto())
    m.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    path = tmp_path / "m.model"
    path.write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        pieces.MergeVocabulary(str(path))


@pytest.mark.parametrize("whole", [False, True])
def test_rows(spark, whole):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)] + [(None, None, 1), (3, "a", None), (3, "a", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, agrees int").repartition(3)
    out = pieces.encode_pieces(d, whole=whole, most=1000)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) for r in pieces.digests(out).collect())
    assert got == sorted((i is not None, i or 0, *wanted(t), True) for i, t, _ in rows)
    assert pieces.digests(pieces.encode_pieces(d.where("false"))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = pieces.op13_score_agenda_pieces(spark, sf).collect()
    assert len(got) == len(texts) and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted(texts[r.doc_id]) and r.agrees for r in got)
