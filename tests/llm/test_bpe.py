"""Encoding against the public library whose ids are wanted, decoding by round trip."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from conftest import TESTDATA
from modgauge.llm import bpe, queries

PATH = public_tokenizers.path(queries.RANKS)
SCHEMA = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    ranks = own.transducer.ranks
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def odd_texts():
    rng = random.Random(5)
    letters = "abcdeaeiou thnrst éüñß漢字🙂́\t\n  '0123.,<|>!-_"
    yield from ["", " ", "\n\n \n", "<|endoftext|>", "don't we'll I'VE", "x" * 5000, "ab" * 4000, "a  b", "a \n b", " a", "a ", "a\n\nb c", "a\u00a0 b\u2003c", "🙂" * 300]
    for _ in range(300):
        yield "".join(rng.choice(letters) for _ in range(rng.randrange(1, 120)))
    yield "".join(rng.choice("qwertyuiopasdfghjklzxcvbnmé") for _ in range(20_000))
    yield "".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(5000))


def test_encodes_as_the_library(own, library):
    for text in odd_texts():
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text), text[:80]
        assert own.decode_bytes(ids).decode() == text


def test_blocks_encode_as_the_library(own, library):
    """Many texts side by side, some of which must not be cut at their spaces."""
    texts = [*odd_texts(), "the end ", " the", "the", "", "", "a b" * 3000, "x \n y the end"]
    rng = random.Random(8)
    for _ in range(3):
        rng.shuffle(texts)
        data = b"".join(t.encode() for t in texts)
        offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
        ids, ends = own.encode_block(np.frombuffer(data, np.uint8), offsets)
        (decimals, cuts), (back, stops) = own.decimals_of(ids, ends), own.decoded(ids, ends)
        for i, text in enumerate(texts):
            expected = library.encode_ordinary(text)
            assert ids[ends[i] : ends[i + 1]].tolist() == expected, text[:80]
            assert bytes(decimals[cuts[i] : cuts[i + 1]]) == "".join(f"{t} " for t in expected).encode()
            assert bytes(back[stops[i] : stops[i + 1]]) == text.encode()
        own.forget()


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_MOVES", 3)
    monkeypatch.setattr(bpe, "LONGEST", 3)
    monkeypatch.setattr(bpe, "LOOKAHEAD", 4)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 5)
    small = bpe.Codec(PATH, public_tokenizers.PATTERN)
    small.transducer.longest = 20  # of the tokens these texts use
    for text in list(odd_texts())[:150]:
        assert small.encode(text) == library.encode_ordinary(text)


def test_stream_never_splits_a_character(own):
    text = "aé漢🙂" * 50
    data = text.encode()
    for step in (1, 2, 3, 5):
        machine = bpe.Utf8Machine()
        got = [machine.feed(data[i : i + step]) for i in range(0, len(data), step)]
        assert "".join(got) + machine.finish() == text
        assert "�" not in "".join(got)
    ids = own.encode(text)
    assert "".join(own.decode_stream([i] for i in ids)) == text


def test_edge_rows(spark):
    rows = [(1, None, "x"), (None, "a b", None), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z"), (4, "w " * 200_000, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    encoded = bpe.encode(docs, PATH, public_tokenizers.PATTERN, docs.doc_id, docs.text)
    assert sorted(len(r.ids) for r in encoded.collect()) == [0, 0, 2, 2, 2, 200_001]
    back = bpe.decode(encoded, PATH, public_tokenizers.PATTERN)
    assert sorted(r.text for r in back.collect()) == sorted(r[1] or "" for r in rows)
    assert bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_query_over_whole_documents(spark, library):
    import hashlib

    folder = f"{TESTDATA}/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op7_bpe(spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


MEMORY = """
import random
from pathlib import Path
import public_tokenizers, pyarrow as pa
from modgauge.llm import bpe

def held():
    return int(Path("/proc/self/status").read_text().split("VmHWM:")[1].split()[0]) / 1024

rng = random.Random(5)
words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(20_000)]
column = pa.array([" ".join(rng.choices(words, k=500)) for _ in range(3000)])
own = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
start = held()
for _, _, ids, ends in bpe._encoded(column, own):
    own.decimals_of(ids, ends), own.decoded(ids, ends)
print(held() - start)
"""


def test_memory_of_encoding():
    """A worker holds the numbers of one block, whatever the size of the batch."""
    root = Path(__file__).parents[2]
    out = subprocess.run([sys.executable, "-c", MEMORY], cwd=root, capture_output=True, text=True, check=True).stdout
    assert float(out) < 100
