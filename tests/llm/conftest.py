import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.01"

P = " ".join(f"passage{i}" for i in range(60))


def small_texts():
    base = " ".join(f"Word{i % 37} thing{i}" for i in range(80))
    return [
        None, "", " \t\n", "one", "ONE", "a b c d", "A b C d", base, base, base + " more", base.replace("thing3", "other"),
        "x " * 400, "é" * 300 + " z", "😀" * 60 + P, P + " tail", "head " + P, base + "\n" + base, "line one\nline one\n\nline two\nline one",
        "<|endoftext|> a <|endoftext|>", "12345 !!! ### $$$ <|im_start|>", P + P, " ".join(f"w{i}" for i in range(30000)), "Straße naïve ﬁ", "ABİ İ ΟΣ, it's e\u0301 x,\u3000y\x1cz \xa0 q",  "the the the the the the the the the the the the",
    ]


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    """A folder of small tables with nulls, ties, repeats and columns of clashing names."""
    d = tmp_path_factory.mktemp("small")
    t = small_texts()
    n = len(t)
    clash = {c: pa.array([f"{c}{i}" for i in range(n)]) for c in ("key", "rep", "word", "stratum", "n", "sig", "spans", "row", "seq", "_range", "held_out", "n_words", "ids")}
    pq.write_table(pa.table({"doc_id": pa.array(range(10, 10 + n), pa.int64()), "text": pa.array(t, pa.string()), "lang": pa.array([None if i % 5 == 0 else ["en", "fr"][i % 2] for i in range(n)], pa.string()), "source": pa.array([None] * n, pa.string()), "n_chars": pa.array([len(x or "") for x in t], pa.int64()), **clash}), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([10, 11, None, 12, 12], pa.int64()), "quality": pa.array([1, 0, 1, None, 1], pa.int32()), "toxic": pa.array([0] * 5, pa.int32())}), d / "labels.parquet")
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b </s> [INST]<|im_end|>"), (1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"), (2, None, None, None), (2, 1, "odd\n\\role<s>", "<<s>> é😀"), (3, 0, "assistant", ""), (4, 0, "system", "x" * 100_000 + "<s>"), (4, 1, "assistant", "\\" * 999)]
    cols = list(zip(*rows))
    pq.write_table(pa.table({"conv_id": pa.array(cols[0], pa.int64()), "turn": pa.array(cols[1], pa.int64()), "role": pa.array(cols[2], pa.string()), "text": pa.array(cols[3], pa.string()), "piece": pa.array(range(len(rows)))}), d / "conversations.parquet")
    return str(d)


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    """Tables in which doc_ids repeat, with the same text and with others, and are null."""
    d = tmp_path_factory.mktemp("odd")
    rand = random.Random(5)
    word = lambda: "".join(rand.choices("abcdefghij", k=rand.randint(2, 7)))
    prose = [" ".join(word() for _ in range(rand.randint(5, 300))) for _ in range(12)]
    rows = [(7, prose[0]), (7, prose[1]), (7, prose[1]), (None, prose[2]), (None, prose[3] + " " + prose[0]), (None, prose[3]), (None, None), (None, ""), (7, None), (8, prose[4] + " " + prose[1]), (9, prose[4]), (9, prose[5]), (9, prose[5] + " x"), (10, prose[6]), (11, prose[6]), (12, prose[7] + "!" + prose[8]), (12, prose[9] + "?" + prose[8]), (13, "y " * 9), (13, "y " * 9), (14, None)]
    t = [x for _, x in rows]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array(t, pa.string()), "lang": pa.array([["en", None, "fr"][k % 3] for k in range(len(t))]), "source": pa.array(["s"] * len(t)), "n_chars": pa.array([len(x or "") for x in t], pa.int64())}), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([7, 7, None, 9, 9], pa.int64()), "quality": pa.array([1, 0, 1, None, 1], pa.int32()), "toxic": pa.array([0] * 5, pa.int32())}), d / "labels.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "conversations"):
        pq.write_table(pq.read_table(os.path.join(SF, f"{name}.parquet")).slice(0, 0), d / f"{name}.parquet")
    return str(d)


def texts_of(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet")
    return list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()))
