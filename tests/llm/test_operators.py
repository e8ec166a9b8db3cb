"""Each operator against a plain version of itself, on rows with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from editlens.llm import decontaminate, html_text, language, line_dedup, order_minhash, packing, repeats, shards, simhash, token_file
from editlens.llm.common import components, numbered
from editlens.llm.range_coder import decode_blocks, encode_blocks
from editlens.llm.tokens import Encoder, default_path

WORDS = "sea stone river cloud märz côte niño winter and the of to was it".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ", ", ".\n"]) for _ in range(n)).strip()


@pytest.fixture(scope="module")
def texts() -> list[tuple[int | None, str | None]]:
    long = prose(1, 4000)
    near = prose(2, 300)
    rows = [(i, prose(100 + i, 5 + 7 * i)) for i in range(12)]
    rows += [(20, long), (21, long[:9000] + prose(5, 50)), (22, near), (23, near.replace("river", "lake", 1)), (24, near)]
    rows += [(30, None), (31, ""), (32, "   \n "), (33, "?! 12"), (34, "word"), (35, "word"), (35, "word"), (None, prose(7, 20)), (36, "a" * 1500)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With extra columns whose names the operators use inside."""
    data = [(i, t, "x", 5, 1.0) for i, t in texts]
    return spark.createDataFrame(data, "doc_id long, text string, shard string, n int, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < -1")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_path())


def id_bytes(encoder, text, end):
    return np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4").tobytes()


def test_encoder_equals_the_library(encoder):
    for text in ["", " ", "a  b", "a   b", "a \n  b", "x <|endoftext|> y", "  lead", "trail  ", "don't  it's", "日本語 テキスト", "1\t 2", "a \x1c b", "½, x. y...", prose(3, 300), "w" * 200 + " " + "w" * 200]:
        assert encoder.encode(text) == encoder.direct(text)


@pytest.mark.parametrize(("shape", "most"), [((1, 1), 9), ((3, 70), 1 << 16), ((5, 900), 4), ((2, 5000), 300)])
def test_range_coder_round_trip(shape, most):
    ids = np.random.default_rng(1).integers(0, most, shape)
    assert (decode_blocks(encode_blocks(ids), shape[1]) == ids).all()


def test_token_file(spark, docs, texts, encoder, empty, tmp_path):
    token_file.write_tokens(docs, f"{tmp_path}/ids")
    got = sorted((r.start, r.n_tokens, r.ids_crc32, r.doc_id) for r in token_file.read_documents(spark, f"{tmp_path}/ids").collect())
    at = 0
    by_id = Counter((i, len(b) // 4, zlib.crc32(b)) for i, t in texts for b in [id_bytes(encoder, t, 0)])
    assert Counter((g[3], g[1], g[2]) for g in got) == by_id
    for start, n, _, _ in got:
        assert start == at
        at += n
    order = [g[3] if g[3] is not None else -1 for g in got]
    assert order == sorted(order)
    token_file.write_tokens(empty, f"{tmp_path}/none")
    assert token_file.read_documents(spark, f"{tmp_path}/none").count() == 0


def test_token_file_finds_damage(spark, docs, tmp_path):
    token_file.write_tokens(docs.limit(5), f"{tmp_path}/ids")
    blocks = spark.read.parquet(f"{tmp_path}/ids").withColumn("crc32", F.col("crc32") + 1)
    blocks.write.parquet(f"{tmp_path}/bad")
    with pytest.raises(Exception, match="damaged"):
        token_file.read_documents(spark, f"{tmp_path}/bad").collect()


def test_crc_of_parts():
    data = [b"abc", b"", b"x" * 1000, b"\0\1"]
    assert token_file.crc32_joined([(len(d), zlib.crc32(d)) for d in data]) == zlib.crc32(b"".join(data))


def test_packing(docs, texts, encoder, empty):
    got = packing.pack(docs, capacity=64, group_pieces=10, with_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * 64
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = Counter()
    for i, t in texts:
        want[(i, id_bytes(encoder, t, 1))] += 1
    have = Counter()
    for (i, _), parts in by_doc.items():
        copies = sum(s == 0 for s, _ in parts)
        have[(i, b"".join(b for _, b in sorted(parts)[::copies]))] += copies
    assert have == want
    assert packing.pack(empty).count() == 0


def test_first_fit_decreasing():
    lengths = np.random.default_rng(2).integers(1, 64, 300)
    free, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(64)
        want[i] = (b, 64 - free[b])
        free[b] -= lengths[i]
    at, offset = packing.first_fit_decreasing(lengths, 64)
    assert [(at[i], offset[i]) for i in range(300)] == [want[i] for i in range(300)]


def test_order_minhash(docs, texts, empty):
    rows = {(r.doc_id, r.n_chars): r for r in order_minhash.fingerprints(docs).collect()}
    assert order_minhash.fingerprints(docs).count() == len(texts)
    plain = sorted(((-1 if i is None else i), t or "") for i, t in texts)
    single = [p for p in plain if p[0] != 35]
    for (i, text), (_, following) in zip(plain, plain[1:] + plain[:1], strict=True):
        if i == 34 or (i, text) not in single:
            continue
        r, half = rows[(None if i < 0 else i, len(text))], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {}
    for i, text in plain:
        r = rows[(None if i < 0 else i, len(text))]
        assert prints.setdefault(text if text.split() else "", r.fingerprint) == r.fingerprint
    assert rows[(20, len(dict(plain)[20]))].near_next > 0.4
    assert order_minhash.fingerprints(empty).count() == 0


def test_order_minhash_numbers_occurrences(spark):
    text = "a b c d e " * 3
    packed = spark.range(1).select(order_minhash._numbered(order_minhash._packed_kmers(F.lit(text))).alias("p")).first()["p"]
    assert len({p >> order_minhash.PLACE_BITS for p in packed}) == len(packed) == 11
    assert sorted(p & ((1 << order_minhash.PLACE_BITS) - 1) for p in packed) == list(range(11))


def test_shards(docs, texts, empty):
    got = shards.assign(docs, 4).collect()
    assert len(got) == len(texts) and {r.law for r in got} == {"bytes"}
    groups: dict[str, int] = {}
    for _, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 16
    place = {}
    for r in got:
        text = next(t or "" for i, t in texts if i == r.doc_id)
        assert r.size == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode())
        assert place.setdefault(text, r.shard) == r.shard
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert shards.assign(empty, 4).count() == 0


@pytest.mark.parametrize("summary", [8, 1 << 16])
def test_minimax_is_exact_at_any_summary_size(spark, monkeypatch, summary):
    monkeypatch.setattr(shards, "SUMMARY", summary)
    sizes = np.random.default_rng(3).integers(1, 60, 120)
    ends = np.cumsum(sizes)
    frame = spark.createDataFrame([(int(e),) for e in ends], "end long")
    cuts = shards.minimax_cuts(frame, 7)
    parts = np.diff([0, *cuts])

    def fits(capacity):
        n, at = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            n, at = (n + 1, s) if at + s > capacity else (n, at + s)
        return n <= 7

    best = next(c for c in range(1, int(ends[-1]) + 1) if fits(c))
    assert max(parts) == best and cuts[-1] == ends[-1] and set(cuts) <= set(ends.tolist())


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(docs, texts, empty):
    got = {(r.doc_id, r.fingerprint): r for r in simhash.groups(docs).collect()}
    prints = [(i, plain_simhash(t)) for i, t in texts]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
            root[find(a)] = find(b)
    for n, (i, f) in enumerate(prints):
        low = min((p[0] for m, p in enumerate(prints) if find(m) == find(n) and p[0] is not None), default=None)
        assert got[(i, f"{f:016x}")].component_id == low
    assert simhash.groups(empty).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for _ in range(80)})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "f long")
    want = {frozenset(p) for p in combinations(prints, 2) if (p[0] ^ p[1]).bit_count() <= 2}
    for small in (3, 1000):
        monkeypatch.setattr(simhash, "SMALL", small)
        got = [frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.close_pairs(frame).collect()]
        assert set(got) == want and len(got) == len(want)


def test_representatives(docs, texts, empty):
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())
    assert ids == [-1, *range(12), 20, 21, 22, 30, 33, 34, 36]  # blank texts have equal fingerprints
    assert simhash.representatives(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (100, 60), (60, 70), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 50 for i in (50, 60, 70, 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeats(docs, texts, empty):
    size = Counter()
    data = [(i, (t or "").encode()) for i, t in texts]
    for _, d in data:
        size.update(d[i : i + repeats.LENGTH] for i in range(len(d) - repeats.LENGTH + 1))
    want = Counter()
    for i, d in data:
        marks = np.zeros(len(d), dtype=bool)
        for at in range(len(d) - repeats.LENGTH + 1):
            if size[d[at : at + repeats.LENGTH]] > 1:
                marks[at : at + repeats.LENGTH] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(int), [0]))))
        spans = tuple(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        want[(i, len(d), int(marks.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~marks]))] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, tuple((s.low, s.end) for s in r.spans), bytes(r.kept)) for r in repeats.remove_repeats(docs).collect())
    assert got == want
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_in_pieces(spark, monkeypatch):
    data = (prose(9, 900) + prose(10, 200) + prose(9, 900)).encode()
    whole = [(int(p), int(a), int(b)) for _, ps, los, his in repeats.anchors(data) for p, a, b in zip(ps, los, his, strict=True)]
    monkeypatch.setattr(repeats, "CHUNK", 500)
    cut = [(int(p), s) for _, ps, los, his in repeats.anchors(data) for p, a, b in zip(ps, los, his, strict=True) for s in range(a, b + 1)]
    assert cut == [(p, s) for p, a, b in whole for s in range(a, b + 1)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_decontaminate(spark, docs, texts, empty):
    passage = prose(1, 4000)[5000:5200]
    typo = passage[:50] + "zz" + passage[52:120] + passage[121:]
    far = "".join(c if i % 8 else "q" for i, c in enumerate(passage))
    items = [(1, passage), (2, typo), (3, far), (4, None), (5, ""), (6, "!!"), (1, passage.upper()), (None, passage), (7, "no such passage anywhere in these rows")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, tuple((x.item, x.distance) for x in r.leaks)) for r in decontaminate.contaminated(docs, frame).collect())
    want = Counter()
    for i, t in texts:
        body, found = decontaminate.plain(t), []
        for item, text in ((1, passage), (2, typo), (3, far)):
            p = decontaminate.plain(text)
            best = decontaminate.Pattern(item, p, decontaminate.ERROR_RATE).distance(body) if body else len(p)
            if best <= int(len(p) * decontaminate.ERROR_RATE):
                found.append((item, best))
        want[(i, tuple(found))] += 1
    assert got == want and any(k[1] for k in want)
    assert decontaminate.contaminated(docs, frame.limit(0)).filter("size(leaks) > 0").count() == 0
    assert decontaminate.contaminated(empty, frame).count() == 0


def test_pattern_distance():
    rng = random.Random(6)
    for _ in range(60):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 25)))
        best = min(edit_distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert decontaminate.Pattern(0, p, 0.1).distance(t) == best


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    rows = []
    while len(rows) < 300:
        a = [rng.choice("abcé") for _ in range(rng.randrange(threshold + 1, 40))]
        b = list(a)
        for _ in range(rng.randrange(threshold + 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "é"])
        b = "".join(b)
        if b and abs(len(a) - len(b)) <= threshold:
            rows.append(("".join(a), b))
    frame = spark.createDataFrame(rows, "a string, b string")
    for r in frame.withColumn("d", line_dedup.banded_distance(F.col("a"), F.col("b"), threshold)).collect():
        assert min(r.d, threshold + 1) == min(edit_distance(r.a, r.b), threshold + 1), r


def test_line_dedup(spark, empty):
    long = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [
        (1, f"{long}\nshort\n\nunique to the first document of all"),
        (2, f"  {long}\nshrt\n{long[:-1]}"),
        (3, f"{long.replace('quick', 'quack')}\nshort\nsomething else that is only found here"),
        (4, f"{long}\n\nshort"),
        (5, None), (6, ""), (7, " \n "), (7, " \n "),
        (8, f"{long.replace('quick brown', 'slow black')}"),
        (None, "a line of a row without an id, long enough"),
        (9, "a line of a row without an id, long enoughs"),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, line int")
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.deduplicate(docs).collect())
    assert got == Counter(
        [
            (1, rows[0][1], 3, 0), (2, "shrt", 3, 2), (3, "something else that is only found here", 3, 2), (4, "", 2, 2),
            (5, None, 0, 0), (6, "", 0, 0), (7, " \n ", 0, 0), (7, " \n ", 0, 0), (8, rows[8][1], 1, 0),
            (None, rows[9][1], 1, 0), (9, "", 1, 1),
        ]
    )
    assert line_dedup.deduplicate(empty).count() == 0


def test_near_lines_finds_all(spark):
    rng = random.Random(8)
    lines = set()
    for _ in range(25):
        base = [rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 45))]
        for _ in range(6):
            other = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(other))
                other[at : at + rng.randrange(2)] = rng.choice(["", "x", "yy"])
            lines.add("".join(other))
    lines = sorted(x for x in lines if len(x) >= line_dedup.LEAST)
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line long, body string")
    got = [(r.a, r.b) for r in line_dedup.near_lines(frame).collect()]
    want = {(i, j) for i, j in combinations(range(len(lines)), 2) if edit_distance(lines[i], lines[j]) <= 2}
    assert set(got) == want and len(got) == len(want)


def test_language_rejects_what_is_unclear(spark):
    """Random letters and texts of two halves go, clean ones stay; sizes by a plain loop over pieces."""
    rng = random.Random(8)
    letters = {"xx": "aeioklmnprstv", "yy": "bcdfghjkwzuy", "zz": "aeghioqrstuwx"}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(2, 8))) for _ in range(300)] for k, v in letters.items()}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    learnt = language.learn(spark.createDataFrame([(text(k, 60), k) for k in words for _ in range(200)] + [("aaa aa", "xx")] * 900, "text string, lang string"))
    assert all(len(v) > 10000 for v in learnt.values())  # copies of one text count once
    clean = [text(k, 80) for k in words for _ in range(40)]
    mixed = [text(a, 40) + " " + text(b, 40) for a, b in (("xx", "yy"), ("yy", "zz"), ("zz", "xx")) for _ in range(20)]
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(500)) for _ in range(60)]
    rows = spark.createDataFrame([(t, kind) for kind, ts in (("clean", clean), ("mixed", mixed), ("noise", noise)) for t in ts], "text string, kind string")
    out = language.predict(rows, learnt).collect()
    share = {kind: np.mean([r.rejected for r in out if r.kind == kind]) for kind in ("clean", "mixed", "noise")}
    assert share["clean"] < 0.02 and share["mixed"] >= 0.9 and share["noise"] >= 0.9
    judge = language.Judge(learnt)
    for r in out[::7]:
        data = language.plain(r.text).encode()
        pieces = [[len(judge.by[k].compress(data[i : i + language.PIECE])) - len(judge.by[k].compress(b"")) for k in sorted(learnt)] for i in range(0, len(data), language.PIECE)]
        total = np.array(pieces).sum(axis=0)
        best, second = sorted(total)[:2]
        assert r.lang_pred == sorted(learnt)[int(total.argmin())] and abs(r.score - (1 - best / second)) < 1e-12
        assert r.rejected == (1 - best / second < language.MARGIN or 1 - sum(map(min, pieces)) / best > language.MIXED)


def test_language(spark, empty):
    by = {"xx": "kalo pira sonu meta vigo", "yy": "strm grblk fnord zwick plonk", "zz": "oua eia iou aeu uia"}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(by[k].split()) for _ in range(30)), k) for i, k in enumerate(list(by) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held", language.held_out())
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {r.doc_id for r in docs.filter("held").collect()} == held
    learnt = language.learn(docs.filter("not held"))
    assert sorted(learnt) == sorted(by) and all(len(v) <= language.DICTIONARY for v in learnt.values())
    out = language.predict(docs.withColumn("score", F.lit("clash")), learnt).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 and not r.rejected for r in out)
    odd = spark.createDataFrame([(None,), ("",), ("12 !?",), (by["xx"] * 20000,)], "text string")
    got = {(r.text or "")[:5]: (r.lang_pred, r.rejected) for r in language.predict(odd, learnt).collect()}
    assert got == {"": ("und", True), "12 !?": ("und", True), by["xx"][:5]: ("xx", False)}
    assert language.learn(docs.limit(0)) == {} and language.predict(empty, learnt).count() == 0
    signs = spark.createDataFrame([(1, "½ ² ⑦"), (2, "12 ½ !")], "doc_id long, text string")
    assert {(r.lang_pred, r.score, r.rejected) for r in language.predict(signs, learnt).collect()} == {("und", 0.0, True)}
    assert {r.lang_pred for r in language.predict(odd, {}).collect()} == {"und"}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>Just a line", ""),
        ("<nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One&nbsp;two \n three<br>four<p>Short.</article><footer>End</footer>", "T & U One two three four Short."),
        ("<article><script>var a='</p>';</script><p>A<b>B</b>C</p><div class='ad'>buy</div><section id=comments><article>nice one</article></section></article>", "ABC"),
        ("<div class=cookie-notice>we use it</div><div><p>This is the text of the page and it is long enough for the rules to be sure of it.</p><p>So it was.</p></div><aside>that is not to be in the text of it at all or so it is</aside>", "This is the text of the page and it is long enough for the rules to be sure of it. So it was."),
        ("<main><form>name of the form</form><ul><li><a href=1>one link</a></li></ul><p>Body.</p></main>", "Body."),
        ("<article><p>" + "long " * 30000 + "</p></article>", ("long " * 30000).strip()),
        ("<article><p>unclosed <i>markup</article></b></p><p>after &#x41;", "unclosed markup"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_extract(spark):
    pages = spark.createDataFrame([(1, None, "c"), (2, "<article>ä b</article>", "d"), (2, "<article>ä b</article>", "d")], "page_id long, html string, text string")
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == Counter({(1, "", 0): 1, (2, "ä b", 3): 2})
    assert html_text.extract(pages.limit(0)).count() == 0


def test_numbered(spark):
    frame = spark.createDataFrame([(i * 37 % 101, None if i % 9 == 0 else i) for i in range(101)], "a long, b long")
    got = sorted(((r["_n"], r.a) for r in numbered(frame, "a").collect()))
    assert [g[0] for g in got] == list(range(101)) and [g[1] for g in got] == sorted(g[1] for g in got)


def test_a_repeated_shingle_links_no_unrelated_texts(spark):
    rng = random.Random(6)
    rows = [(i, " ".join([f"{rng.getrandbits(40):x}" for _ in range(200)] + ["-"] * 24)) for i in range(6)]
    assert simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).count() == 6


def test_keys_of_any_size_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 2)
    monkeypatch.setattr(simhash, "PIVOTS", 1)
    shared = spark.createDataFrame([(i, 1, 40) for i in range(40)] + [(i, 2, 20) for i in range(0, 40, 2)], "node long, k long, n long")
    near = spark.createDataFrame([(i, i + 20) for i in range(20)], "a long, b long")
    got = simhash.linked(shared, lambda pairs: pairs.join(near, ["a", "b"])).collect()
    assert {r.node: r.root for r in got} == {i: i % 20 for i in range(40)}


def test_recall_is_whole_from_the_similarity_up(spark, monkeypatch):
    """Made pairs of 396 shingles each, 40 of a similarity, half of them in one family that shares a template."""
    monkeypatch.setattr(simhash, "SMALL", 5)
    rng = random.Random(1)
    new = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    template, rows, want = new(280), [], {0.78: set(), 0.80: set(), 0.82: set(), 0.85: set()}
    for similarity, ids in want.items():
        shared = -int(-2 * 396 * similarity / (1 + similarity) // 1)
        for p in range(40):
            words = template + new(120) if p % 2 else new(400)
            ids.add(len(rows) + 1)
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: shared + 4] + new(396 - shared)))]
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(0, len(rows), 2)) <= kept
    assert {s: len(ids - kept) for s, ids in want.items()} == {0.78: 0, 0.80: 40, 0.82: 40, 0.85: 40}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<body class="singular showing-comments"><article><p>T</p></article></body>', "T"),
        ('<body class="no-comments"><article class="post comments-closed"><p>T</p></article></body>', "T"),
        ('<div class="content with-sidebar"><p>{}</p></div>', "{}"),
        ('<div class="has-sidebar"><p>{}</p><div class="site-footer">that is not the text of the page or so it is</div></div>', "{}"),
        ('<div class="widget-content"><p>{}</p></div><div id=comments><p>this is what I have to say of it and so it is</p></div>', "{}"),
        ('<div class="widget"><p>{}</p></div><p>Short.</p>', "{} Short."),
        ("<div class=share>this is to be shared with all of them and so it is</div><p>{0}</p><p>{0}</p>", "{0} {0}"),
        ("<ul><li><a href=1>Etusivu</a></ul><p>Tämä on sivun varsinainen teksti, jota lukija etsii, ja se jatkuu vielä pitkään.</p>", "Tämä on sivun varsinainen teksti, jota lukija etsii, ja se jatkuu vielä pitkään."),
        ("<p>" + "吾輩は猫である。名前はまだ無い。" * 5 + "</p>", "吾輩は猫である。名前はまだ無い。" * 5),
    ],
)
def test_names_of_wrappers_and_other_languages(html, text):
    line = "This is the text of the page and it is long enough for the rules to be sure of it."
    assert html_text.main_text(html.replace("{0}", line).replace("{}", line)) == text.replace("{0}", line).replace("{}", line)
