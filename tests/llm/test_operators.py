"""Each operator against a brute-force reading of its definition, with nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import pickle
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import chat, common, decontam, jaccard, language, packing, tokens, topk

DOCS = "doc_id long, text string, n_words long, spans string, items string, lang_pred string, score double, lang string"


def docs_of(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, 0, "s", "i", "p", 0.5, (langs or {}).get(i)) for i, t in enumerate(texts)], DOCS)


def mixed(seed, n=300, vocabulary=40, longest=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéßA") for _ in range(r.randint(1, 5))) for _ in range(vocabulary)]
    made = [" ".join(r.choice(words) for _ in range(r.randint(0, longest))) for _ in range(n)]
    for i in range(n // 3):  # near copies of several degrees
        w = r.choice(made[:n]).split(" ")
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(words)
        made.append(r.choice([" ", "  ", "\n", "\t"]).join(w))
    return [*made, *made[:15], None, "", " \n", "x", "x", "x y", "y" * 3000, "long " * 5000]


def test_chat_round_trip(spark):
    texts = ["<|im_end|>", "<\\|x<\\\\|y", "<", "|", "\\", "<|im_sep|><", "", None, "é\n<|im_start|>user\n", "a" * 5000]
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "a\\n\nb<|", None]), r.choice(texts), 1) for c in range(120) for t in range(r.randint(1, 7))]
    rows += [(500, 1, "user", "b", 1), (500, 1, "user", "a", 1), (500, None, "assistant", "first", 1), (500, 1, "user", "a", 1), (None, 0, "user", "x", 1)]
    rows += [(600, i, "user" if i // 5 % 2 else "assistant", f"turn {i}", 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns long")
    want = defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((t if t is not None else -1, role or "", text or ""))
    got = {x["conv_id"]: x for x in chat.chat_report(df).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        said = "".join(t for _, role, t in turns if role == "assistant")
        told = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    alone = spark.createDataFrame([(None, 0, "user", "x"), (None, 1, "user", "y"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert sorted(x["n_turns"] for x in chat.chat_report(alone).collect()) == [1, 1, 1]
    shown = chat.format_chat(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c<|")], "conv_id long, turn long, role string, text string")).first()
    assert shown["formatted"] == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<\\|<|im_end|>\n"
    assert chat.chat_report(df.limit(0)).count() == 0


def brute_components(texts, size, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("seed", "size", "num", "den"), [(1, 4, 85, 100), (2, 2, 60, 100), (3, 5, 80, 100)])
def test_jaccard_components(spark, seed, size, num, den):
    texts = mixed(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs_of(spark, texts).repartition(3), size, num, den).collect()}
    assert got == brute_components(texts, size, num, den)


def test_jaccard_signatures_lose_no_link():
    """Sets at the threshold share a signature, also where ranges are empty."""
    r = np.random.default_rng(5)
    for num, den in ((85, 100), (80, 100), (50, 100)):
        windows = jaccard.Windows(num, den)
        for _ in range(400):
            n = int(r.integers(1, 400))
            bits = int(r.integers(20, 64))
            a = np.unique(r.integers(0, 1 << bits, n, dtype=np.uint64) << np.uint64(64 - bits))
            b = a.copy()
            while True:
                c = b[r.random(len(b)) > 0.02] if r.random() < 0.5 else np.unique(np.concatenate([b, r.integers(0, 1 << 63, 1 + len(b) // 50, dtype=np.uint64)]))
                common = len(np.intersect1d(a, c))
                if den * common < num * (len(a) + len(c) - common) or not len(c):
                    break
                b = c
                if len(b) > 3 * len(a) + 5:
                    break
            if not np.array_equal(a, b):
                x, y = ({w: (spare, set(sigs.tolist())) for w, spare, sigs in windows.signatures(s)} for s in (a, b))
                assert any(len(x[w][1] & y[w][1]) > max(x[w][0], y[w][0]) for w in x.keys() & y.keys())


def test_a_worker_holds_signature_schemes_once():
    """Each task gets its own copy of the windows; neither tasks nor sizes add to what a worker holds."""
    sizes, held = range(1, 2 * jaccard.KNOWN), []
    for _ in range(3):
        windows = pickle.loads(pickle.dumps(jaccard.Windows(80, 100)))
        for n in sizes:
            for w, _ in windows.of(n):
                windows.scheme(w)
        held.append([f.cache_info().currsize for f in (jaccard.Windows.begin, jaccard.Windows.of, jaccard.Windows.scheme)])
    assert held[0] == held[1] == held[2] and held[0][1] <= jaccard.KNOWN


def test_binary_arrays_take_nothing_from_the_pool():
    for values in ([], [b""], [b"ab", b"", b"c" * 70_000, bytes(3)] * 50):
        want = pa.array(values, pa.binary())
        before = pa.total_allocated_bytes()
        got = common.binary_array(values)
        assert pa.total_allocated_bytes() == before
        got.validate(full=True)
        assert got.equals(want)


def test_jaccard_keeps_one_of_each_group(spark):
    texts = mixed(4)
    df = docs_of(spark, texts)
    kept = [r["doc_id"] for r in jaccard.keep_one(df.unionByName(df.where("doc_id < 5"))).collect()]
    assert sorted(kept) == sorted({c for _, c in brute_components(texts, 5, 80, 100).values()})
    assert jaccard.similar_documents(df.limit(0)).count() == 0


def test_jaccard_summaries_do_not_wrap(spark):
    n = 70_000  # elements with equal first bits
    s = np.arange(n, dtype=np.uint64)
    assert np.frombuffer(jaccard.summary_of(s), np.int32)[0] == n
    summary = [jaccard.summary_of(x) for x in (s[:10], s[: n - 10], s)]
    sets = spark.createDataFrame([(i, k, bytearray(x)) for i, k, x in zip((1, 2, 3), (10, n - 10, n), summary)], "node long, n long, summary binary")
    members = spark.createDataFrame([(9, 1, 0.5), (9, 2, 0.5), (9, 3, 0.1)], "gid long, node long, weight double")
    stars = spark.createDataFrame([], "u long, v long")
    assert [tuple(r) for r in jaccard.other_pairs(members, stars, sets, 85, 100).collect()] == [(2, 3)]


def test_words_of_the_same_structure_do_not_meet(spark):
    """Thue-Morse words defeat any polynomial modulo a power of two."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word[:64]), (4, word[64:128])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["component_id"] for r in jaccard.similar_documents(df).collect()) == [1, 2, 3, 4]


def test_jaccard_hub_of_near_copies(spark, monkeypatch):
    """Groups of more members than a block or a task's share of comparisons."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "DEALT", 4)
    common = [f"c{i}" for i in range(100)]
    texts = [" ".join([*common, f"x{i}"]) for i in range(60)] + [" ".join([*common[:20], *(f"y{i}.{j}" for j in range(40 if i % 2 else 4))]) for i in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs_of(spark, texts)).collect()}
    assert got == brute_components(texts, 4, 85, 100)


def test_much_shared_signatures_leave_in_parts(monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", 50)
    monkeypatch.setattr(jaccard, "HOT", 20)
    r = np.random.default_rng(3)
    want: dict[int, set] = {}
    got: dict[int, set] = {}
    bucket, parts = jaccard.Bucket(7), []
    for _ in range(40):
        sig, node = np.where(r.random(12) < 0.5, 5, r.integers(6, 400, 12)).astype(np.uint64), r.integers(0, 60, 12).astype(np.uint64)
        for a, b in zip(sig.tolist(), node.tolist(), strict=True):
            want.setdefault(a, set()).add(b << 8 | 3)
        parts += bucket.add(jaccard.packed((sig, node, np.full(12, 3, np.uint64))))
    assert bucket.hot == {5}
    parts += bucket.groups()
    for gid, members in parts:
        got.setdefault(gid, set()).update(members.tolist()) if gid else got.setdefault(len(got), set(members.tolist()))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_signatures_that_a_task_shares_leave_at_once(spark):
    """More near copies in one task than LOCAL_HOT, and others of them in tasks with few."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    copies = lambda n: [" ".join([*base[:k], f"x{r.random()}", *base[k:]]) for k in (r.randint(0, 60) for _ in range(n))]
    texts = [*copies(3 * jaccard.LOCAL_HOT), *mixed(8), *copies(30)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.similar_documents(docs_of(spark, texts).repartitionByRange(3, "doc_id")).collect()}
    assert got == brute_components(texts, 4, 85, 100)
    sig, node = np.array([9] * jaccard.LOCAL_HOT + [5, 9 << 40], np.uint64), np.arange(jaccard.LOCAL_HOT + 2, dtype=np.uint64)
    kind = np.full(len(sig), 2 << 6 | 1, np.uint64)
    stays, ((gid, members),) = jaccard.much_shared(sig, np.zeros(len(sig), np.uint64), node, kind)
    assert (np.flatnonzero(stays).tolist(), len(members), kind[0] >> 6) == ([0, *range(jaccard.LOCAL_HOT, jaccard.LOCAL_HOT + 2)], jaccard.LOCAL_HOT, jaccard.MARK)
    bucket = jaccard.Bucket(0)
    assert not list(bucket.add(jaccard.packed((sig[stays], node[stays], kind[stays])))) and bucket.hot == {9}
    assert list(bucket.add(jaccard.packed((sig[:1], node[5:6], kind[1:2])))) == []
    assert [(g, m.tolist()) for g, m in bucket.groups()] == [(gid, [5 << 8 | 2 << 6 | 1])]


def test_keep_one_tells_rows_of_one_id_apart(spark):
    text = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(1, text(0, 200)), (1, text(500, 700)), (1, text(500, 700)), (2, text(5, 205)), (3, ""), (3, ""), (None, None), (None, None), (None, text(3, 203)), (None, text(900, 999)), (None, text(900, 999))]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, key string")
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in jaccard.keep_one(df).collect())
    assert kept == sorted([("1", text(0, 200)), ("1", text(500, 700)), ("3", ""), ("None", ""), ("None", ""), ("None", text(900, 999))])


def test_jaccard_links_through_null_ids(spark):
    text = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(0, text(0, 200)), (None, text(10, 210)), (None, text(10, 210)), (2, text(20, 220)), (3, text(500, 700)), (None, text(900, 1100)), (None, text(905, 1105))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in jaccard.similar_documents(df).collect() if r["component_id"] is not None)
    assert got == [("0", 0), ("2", 0), ("3", 3), ("None", 0), ("None", 0)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


TRICKY = ["'s", "'t", "'re", "'LL", "'ll", "'", "s", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "<|endoftext|>", "\xa0", "’", "あ", "\x1c", "\x85", "ß", "́", "٠", "<|", "😀", "the", " cat"]


def tricky(n=400):
    r = random.Random(9)
    return ["".join(r.choice(TRICKY) for _ in range(r.randint(0, 14))) for _ in range(n)] + [None, "", "a" * 500, "b1 " * 20000, " " * 3000]


def test_token_counts(spark, library):
    texts = tricky()
    got = {r["doc_id"]: r for r in tokens.token_counts(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 512)


def test_full_tables_forget_and_stay_right(library, monkeypatch):
    monkeypatch.setattr(tokens, "POOL", 52_000)
    t = tokens.BulkTokenizer(tokens.default_tokenizer())
    r = random.Random(2)
    for _ in range(6):
        texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(60)) for _ in range(20)]
        want = [library.encode(x, add_special_tokens=False).ids for x in texts]
        got = dict(t.each(texts, True))
        assert [got[i].tolist() for i in range(len(texts))] == want


def test_packing(spark, library):
    texts = tricky(120)
    rows = packing.pack_documents(docs_of(spark, texts), 64).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert [r["length"] for r in mine][1:] == [64] * (len(mine) - 1)
        at = 0
        for r in mine:
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 64) * 1.02 + 1
    assert packing.pack_documents(docs_of(spark, texts).limit(0)).count() == 0


def test_packing_exchanges_between_partitions(spark):
    r = random.Random(1)
    rows = [(i, 0, 0, r.randint(1, 99), i) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECE), 100, partition_pieces=500).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(3000))
    fill = defaultdict(int)
    for x in got:
        fill[x["sequence_id"]] += x["length"]
    assert max(fill.values()) <= 100
    assert len(fill) <= packing.lower_bound(np.array([x[3] for x in rows]), 100) * 1.02 + 1


def test_lower_bound_never_exceeds_a_packing():
    r = np.random.default_rng(4)
    for _ in range(300):
        lengths = r.integers(1, 101, r.integers(0, 60))
        where, offset, fill = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= len(fill)
        assert all(f <= 100 for f in fill)
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 6), 100) == 3


@pytest.mark.parametrize(("candidates", "queries"), [(16_384, 16_384), (50, 2)])
def test_exact_top_k(spark, monkeypatch, candidates, queries):
    monkeypatch.setattr(topk, "CELL_CANDIDATES", candidates)
    monkeypatch.setattr(topk, "CELL_QUERIES", queries)
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.normal(size=8).round(2 if i % 3 else 0)], 0, 1) for i in range(400)]
    rows += [(400, None, 0, 1), (401, [1.0, None], 0, 1), (402, [float("nan")] * 8, 0, 1), (403, [float("inf")] * 8, 0, 1), (500, [1.0, 2.0], 0, 1), (501, [3.0, 1.0], 0, 1), (None, [1.0] * 8, 0, 1), (7, rows[7][1], 0, 1), (600, [1e17] * 8, 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v long, rank long")
    got = defaultdict(list)
    for x in topk.top_inner_products(df).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    good = [(i, [int(np.floor(1024 * c)) for c in v]) for i, v, *_ in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    good = [(i, [min(c, 2**63 - 1) for c in v]) for i, v in good]
    for q, v in good:
        if q % 100 == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), i) for i, w in good if i != q and len(w) == len(v))[:10]
            assert sorted(got.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert not got
    assert topk.top_inner_products(df.limit(0)).count() == 0


def test_lists_are_read_in_part():
    """Vectors of 200 clusters: the median query reads less than half of the lists."""
    r = np.random.default_rng(2)
    centers = r.normal(size=(200, 32)) * 20
    vectors = np.floor(1024 * (centers[r.integers(0, 200, 4000)] + r.normal(size=(4000, 32)) * 0.2)).astype(np.int64)
    lists, depths = topk.Lists(np.arange(4000), vectors), []
    for q in range(0, 4000, 100):
        left, depth = lists.nra(vectors[q].astype(float), lists.ids == q, 10)
        scores = vectors @ vectors[q]
        scores[q] = -(1 << 62)
        assert set(np.lexsort((lists.ids, -scores))[:10]) <= set(left)
        depths.append(depth)
        bar = float(np.sort(scores)[-10])
        assert lists.nra(vectors[q].astype(float), lists.ids == q, 10, bar)[1] <= depth
    assert np.median(depths) < 0.5


def test_lists_are_read_for_many_queries_at_once(monkeypatch):
    """A cell's queries take a bounded number of steps together; ties, repeated rows, bars and scores beyond 64 bits as by brute force."""
    r = np.random.default_rng(4)
    for scale, n in ((3, 700), (1 << 20, 700), (1 << 40, 150), (3, 7), (3, 1)):
        matrix = r.integers(-scale, scale + 1, (n, 6))
        if scale == 1 << 40:
            matrix[:4], matrix[4:] = 1 << 36, -abs(matrix[4:]) - (1 << 34)
        ids = r.permutation(np.r_[np.arange(n - n // 7), np.arange(n // 7)])
        steps, bounds = [], topk.Lists.bounds
        monkeypatch.setattr(topk.Lists, "bounds", lambda self, q, depth, bounds=bounds: steps.append(len(q)) or bounds(self, q, depth))
        at = [int(np.flatnonzero(ids == q)[0]) for q in np.unique(ids)]
        bars = np.where(np.array(at) % 3, 0.0, -np.inf)
        got = topk.cell_top(ids[at], matrix[at], bars, ids, matrix, 10)
        monkeypatch.setattr(topk.Lists, "bounds", bounds)
        assert len(steps) <= 5 and steps[0] == len(at)
        rows = defaultdict(list)
        for q, c, x in zip(*got):
            rows[q].append((-x, c))
        for j, bar in zip(at, bars):
            exact = [max(min(sum(int(a) * int(b) for a, b in zip(matrix[j], w)), 2**63 - 1), -(2**63)) for w in matrix]
            want = sorted((-x, int(i)) for x, i in zip(exact, ids) if i != ids[j])[:10]
            least = sorted(w for w in want if -w[0] >= bar)
            assert sorted(rows[ids[j]])[: len(least)] == least
            if bar < 0:
                assert sorted(rows[ids[j]]) == want


def test_decontamination(spark):
    r = random.Random(8)
    words = ["a", "b", "É1", "c", "Dd", "2"]
    text = lambda n: r.choice([" ", "-", "\n"]).join(r.choice(words) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 2, 5, 9, 10, 11, 14]) + (9 if i % 2 else 0))) for i in range(30)] + [(30, None), (31, "..."), (3, "a b c"), (None, "a a")]
    texts = [text(r.randint(0, 60)) + r.choice(["", " ", items[r.randrange(30)][1]]) for _ in range(250)] + [None, "", "…", "a " * 5000]
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    want = {}
    for i, t in enumerate(texts):
        w, hit, found = low(t), set(), set()
        for item, x in items:
            p = low(x)
            m = min(10, len(p))
            for k in range(len(p) - m + 1 if m and item is not None else 0):
                for at in range(len(w) - m + 1):
                    if w[at : at + m] == p[k : k + m]:
                        hit.update(range(at, at + m))
                        found.add(str(item))
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    df, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: tuple(x)[1:] for x in decontam.contamination_report(df, bench).collect()}
    assert got == want
    blocks = decontam.contamination(df, bench, block_patterns=40)
    assert {x["doc_id"]: len(x["items"]) for x in blocks.collect()} == {i: v[2] for i, v in want.items()}
    assert decontam.contamination_report(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination_report(df.limit(0), bench).count() == 0


def test_language(spark):
    r = random.Random(5)
    pieces = {"xx": ["ka", "to", "mi", "ra"], "yy": ["schl", "ung", "keit", "ver"], "zz": ["eau", "oi", "ç", "ent"]}
    texts, langs, truth = [], {}, {}
    for i in range(600):
        lang = truth[i] = r.choice(list(pieces))
        texts.append(" ".join("".join(r.choice(pieces[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 30))))
        langs[i] = lang if r.random() > 0.02 else None
    texts += [None, "", "123 !?", "ka " * 20000]
    got = {x["doc_id"]: x for x in language.language_report(docs_of(spark, texts, langs), per_language=100).collect()}
    assert len(got) == len(texts)
    for i, x in got.items():
        assert x["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= x["score"] <= 1
    held = [i for i in truth if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in range(600, 604)] == ["und", "und", "und", "xx"]
    unlabelled = language.language_report(docs_of(spark, texts)).collect()
    assert {(x["lang_pred"], x["score"]) for x in unlabelled} == {("und", 0.0)}
    assert language.language_report(docs_of(spark, texts).limit(0)).count() == 0
    both = language.predict(docs_of(spark, texts[:3]), language.train(docs_of(spark, texts, langs), 50))
    assert sorted(both.columns) == sorted(DOCS.replace(",", "").split()[::2])


def test_held_out_labels_change_nothing(spark):
    texts = [f"{'ka to mi' if i % 2 else 'eau oi ent'} {i}" for i in range(80)]
    langs = {i: "xx" if i % 2 else "yy" for i in range(80)}
    other = {i: "other" if zlib.crc32(str(i).encode()) % 4 == 2 else v for i, v in langs.items()}
    a, b = (sorted(map(tuple, language.language_report(docs_of(spark, texts, x)).collect())) for x in (langs, other))
    assert a == b


def reports(spark):
    """name: (the operator over a table, rows that it gives for each row)."""
    from tidelog.llm import pii, repeats, secrets

    bench = spark.createDataFrame([(1, "seven words that stand in no text")], "item_id long, text string")
    return {
        "secrets": secrets.secret_report,
        "jaccard": jaccard.similar_documents,
        "tokens": tokens.token_counts,
        "pii": pii.pii_report,
        "repeats": repeats.without_repeats,
        "decontamination": lambda df: decontam.contamination_report(df, bench),
        "packing": packing.pack_documents,
        "language": language.language_report,
    }


@pytest.mark.parametrize("name", ["secrets", "jaccard", "tokens", "pii", "repeats", "decontamination", "packing", "language"])
def test_odd_rows(spark, name):
    """Null ids and texts, repeated and empty rows, columns named as the operators' own, an empty table."""
    report = reports(spark)[name]
    own = "key, name, node, twin, start, words, n_words, spans, items, score, lang_pred, piece, length, n_tokens, base, weak, marks, a, b".split(", ")
    rows = [(None, "the words of a text without an id"), (None, None), (None, None), (5, "abc def"), (5, "abc def"), (6, ""), (7, None), (8, "x" * 50_000)]
    df = spark.createDataFrame([(*r, "xx", *["x"] * len(own)) for r in rows], f"doc_id long, text string, lang string, {', '.join(f'{n} string' for n in own)}")
    got = report(df).collect()
    per_row = [x for x in got if name != "packing" or x["piece"] == 0]
    assert sorted(str(x["doc_id"]) for x in per_row) == sorted(str(r[0]) for r in rows)
    own_row = lambda x: tuple(v for k, v in x.asDict().items() if k not in ("sequence_id", "offset"))
    assert len({own_row(x) for x in per_row if x["doc_id"] == 5}) == 1
    assert report(df.limit(0)).count() == 0
    strings = report(df.withColumn("doc_id", df["doc_id"].cast("string")))
    assert sorted(str(x["doc_id"]) for x in strings.collect()) == sorted(str(x["doc_id"]) for x in got)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) >= 100")
    held = language.language_report(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(held) > 150
    assert sum(x["lang"] == x["lang_pred"] for x in held) >= 0.97 * len(held)


def test_pipeline_stages_by_brute_force(spark, sf, library):
    """Each stage on what its predecessor kept; a plain reading of its rule gives the rows that it must keep."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    held, out = docs, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out[name] = stage(spark, held, sf)
        assert out[name].columns == docs.columns
        held = out[name].checkpoint()
        out[name] = (rows(held), held)

    model, given = language.train(docs.select("doc_id", "text", "lang")), rows(docs)
    seen, seen_df = out["language_id"]
    assert seen == {i: t for i, t in given.items() if model.predict(t)[2] and model.predict(t)[1] >= corpus_pipeline.LEAST_SCORE}

    ids = sorted(seen)
    first = {ids[c] for _, c in brute_components([seen[i] for i in ids], 5, 80, 100).values()}
    distinct, _ = out["near_duplicates"]
    assert distinct == {i: seen[i] for i in first}

    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = low(r["text"])
        m = min(10, len(w))
        windows |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1 if m else 0)}
    sizes = {len(w) for w in windows}
    leaked = lambda w: any(tuple(w[i : i + m]) in windows for m in sizes for i in range(len(w) - m + 1))
    clean, clean_df = out["decontamination"]
    assert clean == {i: t for i, t in distinct.items() if not leaked(low(t))}

    from tidelog.llm import pii

    masked, masked_df = out["personal_data"]
    assert masked.keys() == clean.keys()
    for r in pii.pii_report(clean_df).collect():
        at, want = 0, ""
        for kind, a, b in sorted((s.split(":") for s in filter(None, r["spans"].split(","))), key=lambda s: (int(s[1]), pii.KINDS.index(s[0]))):
            if int(a) >= at:
                want += clean[r["doc_id"]][at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        assert masked[r["doc_id"]] == want + (clean[r["doc_id"]] or "")[at:]
    assert all(r["n_chars"] == len(r["text"]) for r in masked_df.collect())

    packed = defaultdict(list)
    for r in stages["best_fit_packing"](spark, masked_df, sf).collect():
        packed[r["doc_id"]].append(r)
    assert packed.keys() == masked.keys()
    for i, pieces in packed.items():
        tokens = np.array([*library.encode(masked[i] or "", add_special_tokens=False).ids, 0], "<u4")
        assert sum(p["length"] for p in pieces) == len(tokens)
        for p in pieces:
            assert zlib.crc32(tokens[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == len(masked)


def test_pipeline_stages_with_odd_rows(spark, sf):
    """Nulls in any column, empty and repeated rows, columns with the operators' own names, an empty table."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    names = "key, score, items, marks, spans, lang_pred, name, node, _id, _key".split(", ")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "the text of the a and to of", None, None, None), (10**9, "", "en", "s", 0), (10**9, "", "en", "s", 0)], docs.schema)
    held = docs.unionByName(docs.limit(3)).unionByName(odd).selectExpr("*", *(f"'x' AS {n}" for n in names))
    for _, stage in corpus_pipeline.STAGES[:4]:
        held = stage(spark, held, sf)
        assert held.columns == [*docs.columns, *names]
        held = held.checkpoint()
        assert held.where(" AND ".join(f"{n} = 'x'" for n in names)).count() == held.count() > 0
    assert held.where("doc_id is not null").count() == held.select("doc_id").distinct().where("doc_id is not null").count()
    assert corpus_pipeline.STAGES[4][1](spark, held, sf).count() >= held.count()
    held = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, sf)
    assert held.count() == 0


def test_texts_of_an_unlearned_language_are_rejected(spark):
    import corpus_pipeline

    r = random.Random(6)
    pieces = {"xx": ["ka", "to", "mi", "ra"], "yy": ["schl", "ung", "keit", "ver"], "zz": ["eau", "oi", "ç", "ent"], "vv": ["the", "ing", "whs", "ly"]}
    made = lambda p: " ".join("".join(r.choice(p) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 60)))
    rows = [(i, made(pieces[lang]), lang) for i in range(1200) for lang in [r.choice(list(pieces))]]
    rows += [(2000 + i, made(["жу", "шы", "ёк", "пц"]), None) for i in range(40)] + [(3000, "12 !?", None), (3001, None, None)]
    kept = {x["doc_id"] for x in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    assert len([i for i in range(1200) if i in kept]) >= 1190
    assert len([i for i in range(2000, 2040) if i in kept]) <= 4
    assert not kept & {3000, 3001}


def without_repeats(texts, least):
    """Brute force: lines, and from each sentence the fewest with least words; all but the first of equal ones go."""
    norm = lambda u: re.sub(r"[ \t\r\n]+", " ", u.lower()).strip(" ")
    seen, want = set(), {}
    for i, t in enumerate(texts):
        s = [(m.start(), m.end(), norm(m.group()), "\n" in m.group()) for m in re.finditer(r"[^\n.!?]+[.!?]*[ \t\r\n]*|[\n.!?]+[ \t\r\n]*", t or "")]
        s = [x for x in s if x[2]]
        units, line = set(), 0
        for k, x in enumerate(s):
            if x[3] or k == len(s) - 1:
                units.add((line, k))
                line = k + 1
            n = 0
            for e in range(k, len(s)):
                n += len(s[e][2].split(" "))
                if n >= least:
                    units.add((k, e))
                    break
        gone = set()
        for a, b in sorted(units):
            p = tuple(x[2] for x in s[a : b + 1])
            if sum(len(x.split(" ")) for x in p) >= least:
                if p in seen:
                    gone.update(range(s[a][0], s[b][1]))
                seen.add(p)
        cuts = [c for c in sorted(gone) if c - 1 not in gone]
        cuts = [(c, next(e for e in range(c, len(t) + 1) if e not in gone)) for c in cuts]
        want[i] = (len(cuts), ",".join(f"{a}:{b}" for a, b in cuts), None if t is None else "".join(c for k, c in enumerate(t) if k not in gone))
    return want


@pytest.mark.parametrize("least", [1, 4, 15])
def test_substring_dedup(spark, least):
    from tidelog.llm import repeats

    r = random.Random(11)
    pool = [" ".join(r.choice(["aa", "Bé", "cc", "dd"]) for _ in range(r.randint(1, 9))) + r.choice([".", "! ", ".\n", "\n", "?  ", " \r\n\n ", "...\n"]) for _ in range(60)]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(120)]
    texts += [None, "", "...", "\n---\n---\n", " \nles.\n.\n.les", "\n\n  LES.\nx", "x y " * 4000, *texts[:5]]
    df = docs_of(spark, texts).withColumnsRenamed({"n_words": "twin", "spans": "start", "items": "words", "lang": "u"})
    got = repeats.without_repeats(df.unionByName(df.where("doc_id = 3")).repartition(4), least).collect()
    assert len(got) == len(texts) + 1
    assert {x["doc_id"]: tuple(x)[1:] for x in got} == without_repeats(texts, least)
    assert repeats.without_repeats(df.limit(0), least).count() == 0


def test_substring_dedup_of_many_sentences_is_linear(spark):
    import time

    from tidelog.llm import repeats

    def seconds(n):
        text = "".join(f"This is sentence number {i} of a text that goes on. " for i in range(n))
        df = docs_of(spark, [text, f"x. {text}"])
        began = time.perf_counter()
        assert [x["n_removed"] for x in repeats.without_repeats(df).sort("doc_id").collect()] == [0, 1]
        return time.perf_counter() - began

    seconds(10)
    assert seconds(32_000) < 4 * seconds(8_000) + 4


def test_substring_dedup_equals_duckdb(spark, sf):
    import duckdb

    from tidelog.llm.queries import QUERIES, SQL

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.sql(SQL["op7_substring_dedup"])
    assert sorted(map(tuple, QUERIES["op7_substring_dedup"](spark, sf).select(want.columns).collect())) == sorted(want.fetchall())


def test_components_of_long_paths(spark):
    from tidelog.llm.graph import components

    r = random.Random(3)
    names = r.sample(range(-1000, 1000), 300)
    edges = [(names[i], names[i + 1]) for i in range(199)] + [(names[i], names[250]) for i in range(210, 260)] + [(5000, 5000)]
    got = {x["u"]: x["v"] for x in components(spark.createDataFrame(edges * 2, "u long, v long")).collect()}
    for part in (names[:200], names[210:260]):
        assert {n: min(part) for n in part if n != min(part)}.items() <= got.items()
    assert len(got) == 199 + 49
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
