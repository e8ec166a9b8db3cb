"""BPE by folded ranks, cross-tokenizer alignment and the Merkle manifest against plain versions."""

from __future__ import annotations

import array
import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from editlens.llm import alignment, bpe, merkle, queries
from editlens.llm.tokens import _byte_letters

ODD = [" ", "  ", "\n", "\t", "a", "b", "'s", "'", "é", "日", "1", "23", "\x1c", "\x85", "　", ".", ",,", "don't", "<|endoftext|>", "<s>", "<0x0A>", "\U0001f600", "x" * 30, " the", "ing", "word", "\x00", "▁"]


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(ODD) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    return rows + [(None, "x y"), (5000, None), (5001, ""), (5001, ""), (5002, " "), (5003, "a b " * 9000), (5004, "zab" * 400 + "qu"), (5006, "the same text"), (5006, "the same text")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With extra columns whose names the operators use inside."""
    data = [(i, t, "s", 1, b"") for i, t in texts]
    return spark.createDataFrame(data, "doc_id long, text string, spill string, row int, numbers binary").repartition(3)


@pytest.mark.parametrize("known", [bpe.KNOWN, 50])
def test_bpe_equals_the_library_and_comes_back(docs, texts, known):
    library = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})
    got = bpe.encode(docs, known=known).withColumn("decoded", bpe.decode(F.col("ids"))).collect()
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=key) == sorted(want, key=key)
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(array.array("I", r.ids).tobytes()).hexdigest() for r in got)


def test_long_words_merge_like_the_library():
    ranks = bpe.read_ranks(bpe.default_path())
    library = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for n in (1, 2, 3, 50, 700, 5000):
        word = "".join(rng.choice("abet") for _ in range(n))
        merged = np.frombuffer(bpe.merge_long(word.encode(), ranks), dtype="<u4").tolist()
        assert merged == ([ranks[word.encode()]] if word.encode() in ranks else library.encode_ordinary(word))


def plain_alignment(rows):
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {v: k for k, v in _byte_letters().items()}

    def b_bytes(i):
        piece = b_side.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()

    held, documents = [], Counter()
    for doc, text in rows:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        left, right = [bytes(letters[c] for c in a_side.id_to_token(x)) for x in a], [b_bytes(x) for x in b]
        if not text or not b"".join(left) == b"".join(right) == (" " + text).encode():
            held.append((doc, None))
            continue
        ends_a, ends_b = list(itertools.accumulate(map(len, left))), list(itertools.accumulate(map(len, right)))
        groups, low = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(([x for x, e in zip(a, ends_a, strict=True) if low < e <= end], [x for x, e in zip(b, ends_b, strict=True) if low < e <= end]))
            low = end
        links = Counter((x, y) for l, r in groups for x in l for y in r)
        documents.update(links.keys())
        held.append((doc, (len(a), len(b), groups, links)))
    best: dict[int, int] = {}
    for (x, _), n in documents.items():
        best[x] = max(best.get(x, 0), n)
    for doc, found in held:
        if found is None:
            yield doc, 0, 0, 0, 0, 0, 0, ""
            continue
        n_a, n_b, groups, links = found
        digest = hashlib.sha256(";".join(",".join(map(str, l)) + "|" + ",".join(map(str, r)) for l, r in groups).encode()).hexdigest()
        n_best = sum(m for p, m in links.items() if documents[p] == best[p[0]])
        yield doc, n_a, n_b, len(groups), links.total(), n_best, sum(m * documents[p] for p, m in links.items()), digest


@pytest.mark.parametrize(("spill", "fan_in"), [(alignment.SPILL_RECORDS, alignment.FAN_IN), (300, 3)])
def test_alignment(docs, texts, monkeypatch, spill, fan_in):
    """Also with many spills, several chunks and more than one pass of merges."""
    monkeypatch.setattr(alignment, "FAN_IN", fan_in)
    got = sorted((tuple(r) for r in alignment.align(docs, spill_records=spill).collect()), key=key)
    assert got == sorted(plain_alignment(texts), key=key)


def test_runs_of_numbers_come_back():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, dtype=np.uint64), rng.integers(0, 1 << 40, 20_000).astype(np.uint64), np.sort(rng.integers(0, 300, 9).astype(np.uint64))):
        for steps in (False, True):
            assert (alignment.unpacked(alignment.packed(values, steps)) == values).all()


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """``rows``: doc_id, text, lang, source, n_chars."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest(*map(field, (r[0], r[3], r[2], r[4], text)))

    def tree(nodes):
        paths, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, w in enumerate(where):
                low = w // 16 * 16
                run = nodes[low : low + 16]
                paths[k].append(("".join(run[: w - low]), "".join(run[w - low + 1 :])))
                where[k] = w // 16
            nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        return nodes[0], paths

    sources: dict = {}
    for r in sorted(rows, key=lambda r: (r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, leaf(r, r[1]))):
        sources.setdefault(r[3], []).append(r)
    trees = [tree([leaf(r, r[1]) for r in members]) for members in sources.values()]
    root, tops = tree([t[0] for t in trees]) if trees else (None, [])
    for members, (subroot, paths), top in zip(sources.values(), trees, tops, strict=True):
        for r, path in zip(members, paths, strict=True):
            path = path + top
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = text.translate({c: c + 32 for c in range(65, 91)})
            node = leaf(r, text)
            for before, after in path:
                node = digest(before, node, after)
            yield r[0], leaf(r, r[1]), subroot, root, digest(*[x for level in path for x in level]), node, node == root


@pytest.mark.parametrize(("n", "digits"), [(0, 3), (1, 3), (20, 3), (700, 1)])
def test_manifest(spark, tmp_path, monkeypatch, n, digits):
    """One digit a block makes several rounds; sources are hot, single, null and not ASCII."""
    monkeypatch.setattr(merkle, "DIGITS", digits)
    rng = random.Random(n)
    sources = ["a"] * 30 + ["b", "é", "z", None, *[f"s{i}" for i in range(20)]]
    rows = [(rng.choice([i, i, i, None, 7]), rng.choice([None, "", f"Text {i} É", "lower é"]), rng.choice(["en", None]), rng.choice(sources), rng.choice([None, i])) for i in range(n)]
    data = [(*r, "x", 3) for r in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, rank string, nest int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_merkle(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(plain_manifest(rows), key=key)


def test_empty_tables(docs):
    none = docs.filter("doc_id < -1")
    assert bpe.encode(none).count() == 0
    assert alignment.align(none).count() == 0
