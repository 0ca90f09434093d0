import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.queries import op6_sentencepiece
from ledgerloom.llm.sentencepieces import Pieces, decode_documents, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
REF = sentencepiece.SentencePieceProcessor(model_file=PATH)
OURS = Pieces(PATH)


def ids(texts):
    return [np.frombuffer(b, dtype="<u4").tolist() for b in OURS.encode(texts)]


def test_ids_are_those_of_the_library():
    r = random.Random(3)
    texts = ["", " ", "▁", "a▁b", "<s>x</s>", "x" * 3000, " " * 300 + "y" + " " * 99, "é😀̀안" * 50]
    texts += ["".join(r.choice(" abcthe▁\n\t.é😀<>0x'　안") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    assert ids(texts) == REF.encode(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",), exclude_characters="\0"), max_size=40), max_size=5))
def test_any_text(texts):
    assert ids(texts) == REF.encode(texts)
    assert [OURS.decode(b) for b in OURS.encode(texts)] == [REF.decode(i) for i in REF.encode(texts)]


def test_query_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    out = {r.doc_id: r for r in op6_sentencepiece(spark, "/root/testdata/sf0.01").collect()}
    for i, t in zip(docs.doc_id, docs.text):
        want = np.array(REF.encode(t), dtype="<u4")
        assert (out[i].n_ids, out[i].ids_crc32, out[i].decoded_sha256) == (len(want), zlib.crc32(want.tobytes()), hashlib.sha256(t.encode()).hexdigest())


def test_round_trip_and_edges(spark):
    rows = [(1, None), (None, ""), (2, "a b"), (2, "a b"), (3, "long é " * 30_000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ids int")
    back = decode_documents(encode_documents(df, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert encode_documents(df.limit(0), PATH).count() == 0
