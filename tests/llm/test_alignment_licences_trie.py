"""Token alignment, licence scan and prefix trie against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import public_tokenizers as P
import pytest

from tickerloom.llm import license_scan, prefix_trie, queries, token_alignment as T
from tickerloom.llm.digests import ordered_sha256

SF = "/root/testdata/sf0.001"
JSON, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- token alignment


def aligned(texts):
    """Rows of the contract by the libraries' ids of whole texts."""
    both = T.pair(JSON, PIECES)
    groups_of, links = [], Counter()
    for text in texts:
        groups, a_bytes, b_bytes = [], b"", b""
        if text:
            a, b = both.library.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
            if not all(b"".join(side[i] for i in ids) == (" " + text).encode() for side, ids in ((both.a_bytes, a), (both.b_bytes, b))):
                a, b = [], []
            ends_a = np.cumsum([len(both.a_bytes[i]) for i in a]).tolist()
            ends_b = np.cumsum([len(both.b_bytes[i]) for i in b]).tolist()
            i = j = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
                groups.append((a[i:x], b[j:y]))
                i, j = x, y
            assert (i, j) == (len(a), len(b))
        groups_of.append(groups)
        links.update((g[0][-1], g[1][-1]) for g in groups)
    highest = defaultdict(int)
    for (_, b), n in links.items():
        highest[b] = max(highest[b], n)
    out = []
    for groups in groups_of:
        pairs = [(g[0][-1], g[1][-1]) for g in groups]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(pairs),
            sum(links[p] == highest[p[1]] for p in pairs), sum(links[p] for p in pairs), hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return out


@pytest.mark.parametrize("segment", [T.SEGMENT, 90])
def test_alignment_equals_whole_texts(spark, texts, awkward, segment):
    rows = texts[:60] if segment < T.SEGMENT else texts
    rows = rows + [(r["doc_id"], r["text"]) for r in awkward.collect()]
    rows += [(900, "x" * 400), (901, "<|endoftext|> </s> <s> a  b \n\n  c "), (902, " "), (903, "  two"), (910, "x\t y  \n z\x1c  q\x85 r "), (911, "a \n b\n c  "), (907, "mark \u2581 in it"), (908, "\u2581"), (909, "long " * 60 + "a\u2581 " + "long " * 60), (906, "a" + " " * 3000 + "b"), ((1 << 60) + 1, "large id"), (904, "日本語" * 200 + " end of it"), (905, "  odd　space a b")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rid int")
    got = sorted_rows(T.alignment(df, JSON, PIECES, segment=segment))
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, aligned([t for _, t in rows]))), key=str)


def test_alignment_of_the_table_and_of_nothing(spark, texts, empty):
    got = sorted_rows(queries.op11_token_alignment(spark, SF))
    assert got == sorted(((i, *w) for (i, _), w in zip(texts, aligned([t for _, t in texts]))), key=str)
    assert T.alignment(empty, JSON, PIECES).collect() == []


def test_fragments_compose_in_any_tree():
    rng = np.random.default_rng(5)
    state = lambda f: (f.closed, f.prefix, ";".join(f.groups), f.n_groups, [tuple(map(int, p)) for x in f.links for p in zip(*x)], f.suffix)
    for _ in range(60):
        size = int(rng.integers(1, 90))
        ends = [np.unique(np.r_[rng.integers(1, size + 1, rng.integers(0, 40)), size]) for _ in range(2)]
        ids = [rng.integers(0, 500, len(e)) for e in ends]
        parts = []
        for lo in range(0, size, 7):
            keep = [(e > lo) & (e <= lo + 7) for e in ends]
            parts.append(T.chunk_fragment(ids[0][keep[0]], ends[0][keep[0]], ids[1][keep[1]], ends[1][keep[1]]))
        left = reduce(T.compose, parts, T.Fragment())
        right = reduce(lambda g, f: T.compose(f, g), reversed(parts), T.Fragment())
        tree = parts
        while len(tree) > 1:
            tree = [reduce(T.compose, tree[i : i + 3]) for i in range(0, len(tree), 3)]
        whole = T.chunk_fragment(ids[0], ends[0], ids[1], ends[1])
        assert state(left) == state(right) == state(tree[0]) == state(whole)
        assert state(T.segment_fragment(ids[0], ends[0], ids[1], ends[1], chunk=5)) == state(whole)


def test_segments_are_the_text():
    for text in ("", "a", "é b c " * 50, "x" * 300, "日本 語 " * 90):
        parts = T.segments(" " + text, 64)
        assert "".join(t for _, t in parts) == " " + text
        assert [s for s, _ in parts] == np.cumsum([0, *[len(t.encode()) for _, t in parts]])[:-1].tolist()


def test_bytes_that_are_not_the_text_are_seen():
    both = T.Pair(JSON, PIECES)
    assert [r[2] for r in both.tokens([" a\u2581b", " sound", " "])] == [False, True, False]
    first = both.b.encode("sound")[0]
    both.b_table = T.TokenBytes([b"?" * len(x) if i == first else x for i, x in enumerate(both.b_bytes)])
    assert [r[2] for r in both.tokens([" sound", " a"])] == [False, True]
    pairs = both.codes[::-7]
    assert (both.codes[both.code([(pairs >> 32, pairs & 0xFFFFFFFF)])] == pairs).all()


# ---- licences


def licences(text, percent=80, block=96):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, own, more, best = [], set(), set(), 0.0
    for phrase, label in license_scan.PHRASES.items():
        parts = phrase.split()
        at = [i for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
        starts += at
        own |= {label} if at else set()
    step = block // 2
    for at in range(0, max(1, len(words) - block + step), step) if words else ():
        held = set(words[at : at + block])
        for label, templates in license_scan.TEMPLATES.items():
            for t in templates:
                wanted = set(t.split())
                n = len(wanted & held)
                if 100 * n >= percent * len(wanted):
                    more.add(label)
                    best = max(best, n / len(wanted))
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | more)), 1.0 if starts else best)


def test_licences_equal_every_block_with_every_template(spark, texts, awkward):
    rows = texts + [(r["doc_id"], r["text"]) for r in awkward.collect()]
    filler = " ".join(f"filler{i}" for i in range(200))
    for k, t in enumerate(t for ts in license_scan.TEMPLATES.values() for t in ts):
        parts = t.split()
        rows.append((1000 + k, f"{filler} {t.upper()}. {filler}"))
        rows.append((2000 + k, f"{filler} {' '.join(parts[: -max(1, len(parts) // 5)])} {filler}"))
        rows.append((3000 + k, f"{' '.join(parts[: len(parts) // 2])} {filler} {' '.join(parts[len(parts) // 2 :])}"))
    rows += [(4000, "CC BY-NC cc-by-nc; under the MIT\nlicense"), (4001, "under the MİT license under the mit licensK"), (4002, "...")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, words string")
    assert sorted_rows(license_scan.license_labels(df)) == sorted(((i, *licences(t)) for i, t in rows), key=str)


def test_licences_of_nothing_and_wrong_templates(spark, empty, awkward):
    assert license_scan.license_labels(empty).collect() == []
    with pytest.raises(ValueError, match="half a block"):
        license_scan.license_labels(awkward, templates={"long": (" ".join(f"w{i}" for i in range(60)),)})
    with pytest.raises(ValueError, match="ASCII"):
        license_scan.license_labels(awkward, templates={"odd": ("un été",)})


# ---- conversations


def trie(rows, head=4):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, key), (role, text)))
    turns = {c: [t for _, t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % head
        rebuilt = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(c)
        ends[rebuilt].append(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        shown = ",".join(map(str, sorted(ends.get(node, ()))))
        out.append((who[0], len(node), members[node[:-1]][0] if node else None, len(who), len(children), len(leaves), saved, hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [3, 8])
def test_trie_equals_plain_python(spark, width):
    rng = random.Random(width)
    rows = []
    for conv in [*range(0, 70), *range(120, 128), 200, 5000, 9000]:
        for turn in range(rng.choice([1, 1, 2, 3, 7, 12])):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", None]), rng.choice(["a b", "c  d\ne", "", None])))
    rows += [(61, 0, "user", "a b")] * 3 + [(None, 1, "user", "lost"), (7001, 0, "u", "x y z"), (7002, 0, "u", "x"), (7003, 3, "u", "x")]
    rows += [(8000, t, "u", f"t{t % 5}") for t in range(1300)] + [(8400, t, "u", f"t{t % 5}") for t in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, id int")
    if width == 3:  # the comparison below is quadratic in the nodes
        rows = [r for r in rows if r[0] != 8000]
        df = df.where("conv_id is null or conv_id <> 8000")
    got = sorted_rows(prefix_trie.trie_nodes(df, width=width))
    if width == 8:
        deep = [r for r in got if r[0] == 8000]
        assert max(r[1] for r in deep) == 1300 and all(r[4] <= 1 for r in deep if r[1] > 40)
        rows = [r for r in rows if r[0] != 8000]
        got = sorted_rows(prefix_trie.trie_nodes(df.where("conv_id is null or conv_id <> 8000"), width=width))
    assert got == trie(rows)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie_nodes(df).collect() == []
    assert prefix_trie.trie_nodes(df.limit(0)).collect() == []


def test_ordered_digests(spark):
    rows = [(k, i, f"p{i}") for k in range(3) for i in range(k * 700)]
    df = spark.createDataFrame(rows, "k long, at long, part string").repartition(5)
    got = {r["k"]: r["sha256"] for r in ordered_sha256(df, ["k"], "at", "part", ",").collect()}
    assert got == {k: hashlib.sha256(",".join(f"p{i}" for i in range(k * 700)).encode()).hexdigest() for k in (1, 2)}
