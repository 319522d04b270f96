"""Every operator against plain Python, and on awkward rows."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest

from tickerloom.llm import (
    aligned_lines, best_fit, count_tree, heap_counts, language, queries, repetition, stages, substrings, suffix_dedup, topk_search, transducer,
)
from tickerloom.llm.suffix_array import common_prefixes, suffix_array

SF = "/root/testdata/sf0.001"
RANKS, PIECES, JSON = (P.path(n) for n in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "byte_bpe_50k.json"))


def rows(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


def test_top_k_equals_all_inner_products(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    v = np.floor(256 * np.stack(table["embedding"]).astype(float)).astype(int)
    ids = table["vec_id"].tolist()
    want = set()
    for a in (k for k, i in enumerate(ids) if i % 50 == 0):
        best = sorted((-int(v[a] @ v[b]), ids[b]) for b in range(len(ids)) if b != a)[:5]
        want |= {(ids[a], r, i, -s) for r, (s, i) in enumerate(best, 1)}
    got = queries.op1_threshold_topk(spark, SF).collect()
    assert {tuple(r)[:4] for r in got} == want


def test_top_k_of_copies_and_unsound_vectors(spark):
    data = [(i, [1.0, 0.5]) for i in range(20)] + [(50, [1.0, 0.5]), (51, None), (52, [None, 1.0]), (53, [float("nan"), 1.0]), (54, []), (None, [1.0, 1.0]), (55, [-1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk_search.top_k(df, df.where("vec_id % 50 = 0"), k=5).collect())
    assert got == [(0, r, i, 81920) for r, i in enumerate((1, 2, 3, 4, 5), 1)] + [(50, r, i, 81920) for r, i in enumerate((0, 1, 2, 3, 4), 1)]
    assert topk_search.top_k(df.limit(0), df.limit(0)).collect() == []


def broadcast_columns(df):
    """Columns that a query that has run sent through the driver."""
    plans, names = [df._jdf.queryExecution().executedPlan()], set()
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        elif plan.nodeName().endswith("QueryStage"):
            plans.append(plan.plan())
        elif plan.nodeName() == "BroadcastExchange":
            names |= {plan.output().apply(i).name() for i in range(plan.output().size())}
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return names


def test_top_k_sends_no_copies_through_the_driver(spark, monkeypatch):
    """Queries that meet 30 blocks are shuffled to them; as a broadcast all copies would pass the driver."""
    monkeypatch.setattr(topk_search, "BLOCK_BYTES", 1)
    monkeypatch.setattr(topk_search, "QUERY_BLOCKS", 2, raising=False)
    v = np.random.default_rng(3).integers(-300, 300, (1900, 32))
    df = spark.createDataFrame([(i, x) for i, x in enumerate((v / 256).tolist())], "vec_id long, embedding array<double>")
    found = topk_search.top_k(df, df.where("vec_id % 3 = 0"), k=3)
    got = {tuple(r) for r in found.collect()}
    scores = v @ v.T
    want = set()
    for a in range(0, 1900, 3):
        best = sorted((-int(s), b) for b, s in enumerate(scores[a]) if b != a)[:3]
        want |= {(a, r, b, -s) for r, (s, b) in enumerate(best, 1)}
    assert got == want
    assert not broadcast_columns(found) & {"data", "q_data"}


def test_repetition_measures(spark, texts):
    for _, text in texts:
        words = text.encode().split()
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))
        got = repetition.measure(text)
        assert got[:5] == want
        assert got[5] == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
    again = "one two three four five six seven eight nine ten eleven twelve. " * 6
    assert not repetition.measure(again + " ".join(f"x{i}" for i in range(90)))[6]


def test_suffix_arrays():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 30, 400):
        for letters in (1, 2, 5):
            data = bytes(rng.integers(97, 97 + letters, n).astype(np.uint8))
            order = suffix_array(np.r_[np.frombuffer(data, np.uint8).astype(int) + 1, 0], 257)
            assert order.tolist() == sorted(range(n + 1), key=lambda i: data[i:])
            before, shared = common_prefixes(data + b"\x00", order)
            for i in range(n):
                j, k = int(before[i]), 0
                if j >= 0:
                    while max(i, j) + k < n and data[i + k] == data[j + k]:
                        k += 1
                    assert min(int(shared[i]), n - max(i, j)) == k


@pytest.mark.parametrize("anchor_bytes", [suffix_dedup.ANCHOR_BYTES, 600])
def test_repeated_bytes(spark, texts, anchor_bytes):
    """With the usual bound, and with one that sends all anchors to the hash path."""
    width = 400
    count = Counter(d[i : i + width] for d in (t.encode() for _, t in texts) for i in range(len(d) - width + 1))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r["doc"]: r["starts"] for r in suffix_dedup.repeated_places(docs, width, anchor_bytes=anchor_bytes).collect()}
    for doc, text in texts:
        data = text.encode()
        want = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if count[data[i : i + width]] > 1:
                want[i : i + width] = b"\1" * width
        assert bytes(suffix_dedup.removed_bytes(len(data), found.get(doc), width).astype(np.uint8)) == bytes(want)


def test_repeated_word_windows(spark, texts):
    first, want = {}, {}
    for doc, text in sorted(texts):
        w = text.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), doc) < doc:
                gone[i : i + 50] = [True] * 50
        want[doc] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    assert rows(queries.op4_count_min_substrings(spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_patience_alignment():
    assert aligned_lines.align([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert aligned_lines.align([5, 1, 2, 3, 6], [7, 1, 2, 3, 8, 9]) == [(1, 1), (2, 2), (3, 3)]
    assert aligned_lines.align([], [1]) == []


def test_common_blocks_leave_the_later_document(spark):
    block = "\n".join(f"shared line number {i} of a longer passage" for i in range(5))
    docs = [(1, "first start\n" + block + "\nfirst end"), (2, "other start\n" + block + "\nother end"), (3, "nothing in common here at all")]
    docs += [(10 + i, block + f"\nending {i}") for i in range(40)]
    got = rows(aligned_lines.kept_lines(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "n_removed", "kept")
    assert got[1][0] == 0 and got[3][0] == 0
    assert got[2] == (5, "other start\nother end")
    assert all(got[10 + i] == (5, f"ending {i}") for i in range(40))


def test_fillings_place_every_piece_once():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.lognormal(5.5, 1.2, 3000).astype(int) % 1024 + 1, 1024)
    plan = best_fit.plan_fillings(dict(Counter(lengths.tolist())), 1024)
    assert Counter(n for f, k in plan for n in f for _ in range(k)) == Counter(lengths.tolist())
    assert all(sum(f) <= 1024 for f, _ in plan)
    assert sum(k for _, k in plan) <= -(-lengths.sum() // 1024) + 2


def test_packing(spark):
    got = queries.op6_best_fit_packing(spark, SF).toPandas().sort_values(["sequence_id", "offset"])
    for _, part in got.groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]] and part["length"].sum() <= 1024


def test_near_duplicate_components(spark, texts):
    sets = {}
    for doc, text in texts:
        w = text.encode().lower().split()
        sets[doc] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    holders, shared, root = defaultdict(list), Counter(), {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for found in holders.values():
        shared.update(combinations(sorted(found), 2))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), k in shared.items():
        if 100 * k >= 90 * (len(sets[a]) + len(sets[b]) - k):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    want = {d: (len(s), find(d)) for d, s in sets.items()}
    assert rows(queries.op7_count_tree_join(spark, SF), "doc_id", "n_shingles", "component_id") == want


def test_blocks_of_a_family_join(spark):
    """A family over several blocks gives the components that one block gives."""
    base = [f"word{i}" for i in range(400)]
    rng = np.random.default_rng(5)
    docs = []
    for i in range(60):
        w = list(base)
        for k in rng.choice(400, int(rng.integers(1, 9)), replace=False):
            w[k] = f"new{i}_{k}"
        docs.append((i, " ".join(w)))
    texts_ = substrings.keyed(spark.createDataFrame(docs, "doc_id long, text string"))
    signed = count_tree.signatures(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90).cache()

    def groups(block_rows):
        links = count_tree.set_links(signed, texts_, 3, 90, block_rows)
        return {(r["node"], r["root"]) for r in count_tree.components(links).collect()}

    assert groups(1000) == groups(7)


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97


def test_encoding_equals_the_library(spark, texts):
    import tiktoken

    c = transducer.codec(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    odd = ["", " ", "a  b \n c", "\x1c\x85 x", "don't we'll", "ß漢字😀́", "a" * 3000 + " " * 700, "<|endoftext|>", "�​"]
    for text in [t for _, t in texts] + odd:
        ids = c.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert "".join(c.decode(ids, 3 if len(text) < 99 else 999)) == text


def test_counts_equal_the_library(texts):
    import sentencepiece

    c = heap_counts.counter(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    odd = ["", " ", "a  b \n c", "<s></s><unk>", "<0x0A>", "▁▁ ▁", "ß漢字😀́\x00", "a" * 2000]
    for text in [t for _, t in texts] + odd:
        assert c.count(text) == len(library.encode(text))


PER_ROW = {
    "repetition": repetition.repetition_rules,
    "bytes": suffix_dedup.kept_bytes,
    "windows": substrings.kept_words,
    "lines": aligned_lines.kept_lines,
    "components": count_tree.component_rows,
    "languages": language.identify,
    "codec": lambda d: transducer.round_trip_digests(d, RANKS, P.PATTERN),
    "counts": lambda d: heap_counts.token_counts(d, PIECES),
}
STAGES = {
    "language": stages.known_language,
    "lines": stages.without_common_blocks,
    "near": stages.without_near_duplicates,
    "windows": stages.without_repeated_windows,
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_awkward_rows_keep_their_number(awkward, empty, name):
    assert PER_ROW[name](awkward).count() == awkward.count()
    assert PER_ROW[name](empty).collect() == []


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_the_columns(awkward, empty, name):
    out = STAGES[name](awkward)
    assert out.schema.names == awkward.schema.names and out.count() > 0
    assert STAGES[name](empty).collect() == []


def test_awkward_rows_pack(awkward, empty):
    pieces = best_fit.token_pieces(awkward, JSON, 1024, 2)
    assert best_fit.pack(pieces, 1024).count() == pieces.count()
    assert best_fit.pack(best_fit.token_pieces(empty, JSON, 1024, 2), 1024).collect() == []


def test_the_pipeline_runs(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).toPandas()
    assert len(got) and got.groupby("sequence_id")["length"].sum().max() <= 1024


def test_ranks_give_the_ids_of_the_tokenizer():
    from tokenizers import Tokenizer

    ids, whole, ranks = best_fit.Ids(JSON), Tokenizer.from_file(JSON), best_fit.byte_level_ranks(JSON)
    words = [b.decode() for b in ranks if b.decode("utf-8", "ignore").encode() == b]
    marks = [f" a{chr(c)}1{chr(c)}. {chr(c)} {chr(c)}{chr(c)}!" for c in range(0x30000) if not 0xD800 <= c < 0xE000][::7]
    for text in [*words, *marks, "", "a<|endoftext|>b", " " * 5000 + "x", "x" + "\n" * 999 + " y", "x \x1c\x85y" * 100]:
        assert ids(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
