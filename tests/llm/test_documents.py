"""Document operators against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalens.llm import queries
from stratalens.llm.decontaminate import contamination, drop_contaminated
from stratalens.llm.lines import drop_repeated_lines, repeated_lines
from stratalens.llm.near_texts import drop_near_copies, shingles, wide_fingerprint
from stratalens.llm.packing import Packer, WordEncoder, best_fill, pack
from stratalens.llm.quality import keep_good, score_documents
from stratalens.llm.sharding import shard_documents
from stratalens.llm.simhash import _golay, bucket_links, fingerprint, keys_of, simhash_dedup
from stratalens.llm.suffixes import blocks_of, cut_repeats

PATH = public_tokenizers.path("byte_bpe_50k.json")
RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(2, 9))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choices(VOCABULARY, k=n))


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# Packing


def test_words_encode_like_whole_texts():
    e = WordEncoder(PATH)
    cases = ["", " a", "a  b", "a\n\nb", "a \n b", "x<|endoftext|>y z", "a\tb c d", "  ", "don't we'll 12,345 été\n", "a b", "a\0b c", "ß\r\nx", "日本 語"]
    for x in cases:
        assert np.frombuffer(e.encode(x), "<u4").tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\tab'é1.,<|>Z　", max_size=40))
def test_words_encode_like_whole_texts_property(x):
    e = test_words_encode_like_whole_texts_property.__dict__.setdefault("e", WordEncoder(PATH))
    assert np.frombuffer(e.encode(x), "<u4").tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=6), st.integers(0, 60))
def test_best_fill_is_optimal(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    got = best_fill(counts, room)
    assert all(k <= counts[n] for n, k in got.items())
    assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= room)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=40))
def test_packer_places_every_id_once(lengths):
    p = Packer(16, 8, 2)
    for i, n in enumerate(lengths):
        p.add(i, np.full(n, i, "<u4").tobytes())
    p.close()
    seen, size = defaultdict(list), Counter()
    for row, start, ids, seq, offset in p.out:
        seen[row].append((start, len(ids) // 4))
        assert offset == size[seq]
        size[seq] += len(ids) // 4
    for i, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[i]):
            assert start == at
            at += k
        assert at == n
    assert all(n == 16 or n & (n - 1) == 0 for n in size.values())


def check_pack(rows, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    by, size = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        size[r.sequence_id].append((r.offset, r.length))
    assert set(by) == set(docs)
    for k, pieces in by.items():
        ids, at = [*t.encode(docs[k] or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in size.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0


def test_packing_query(spark, sf, texts):
    check_pack(queries.op2_packing(spark, sf).collect(), texts)


def test_packing_edges(spark, make):
    docs = {1: None, 2: "", 3: prose(6000), 4: "a\n", None: "null id"}
    check_pack(pack(make(list(docs.items())), PATH).collect(), docs)
    assert pack(make([]), PATH).collect() == []
    twice = pack(make([(1, "a b"), (1, "a b")]), PATH).collect()
    assert sum(r.length for r in twice) == 6


# Sharding


def check_shards(rows, docs):
    total = Counter()
    homes = defaultdict(set)
    slots = defaultdict(list)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        total[r.shard] += r.size
        homes[raw].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(x) == 1 for x in homes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(total) <= set(range(8))
    return total


def test_sharding_is_minimax(spark, sf, texts):
    total = check_shards(queries.op3_sharding(spark, sf).collect(), texts)
    groups = spark.read.parquet(f"{sf}/documents.parquet").groupBy(F.xxhash64("text").alias("h")).agg(F.sum(F.octet_length("text") + 1).alias("n")).orderBy("h")
    sizes = [r.n for r in groups.collect()]

    def shards(capacity):
        n, left = 0, 0
        for s in sizes:
            if s > left:
                n, left = n + 1, capacity
            left -= s
        return n

    best = max(total.values())
    assert shards(best) <= 8 and shards(best - 1) > 8


def test_sharding_edges(make):
    docs = {1: None, 2: "", 3: "x" * 5000, 4: "x" * 5000, 5: "y", 6: "é"}
    check_shards(shard_documents(make(list(docs.items()))).collect(), docs)
    assert shard_documents(make([])).collect() == []
    same = shard_documents(make([(i, "same") for i in range(30)])).collect()
    assert {r.shard for r in same} == {0} and sorted(r.slot for r in same) == list(range(30))


# Quality


def test_votes_against_brute_force(spark, sf):
    from stratalens.llm import quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), 60)
    assert len(model.labels) == len(model.vectors) <= 60
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()] + ["", "x"]
    got = model.score(np.stack([quality.terms(t) for t in texts]))
    for t, score in zip(texts, got, strict=True):
        counts = quality.terms(t).astype(float)
        parts = []
        for at, block in enumerate(quality._BLOCKS):
            x = counts[block] if at == 2 else np.log1p(counts[block]) * model.idf[block]
            parts.append(x / (np.linalg.norm(x) or 1))
        v = np.concatenate(parts) @ model.basis
        v = v / (np.linalg.norm(v) or 1)
        sims = [sum(float(a) * float(b) for a, b in zip(v, row, strict=True)) for row in model.vectors]
        best = sorted(range(len(sims)), key=lambda i: -sims[i])[: quality.NEIGHBOURS]
        weights = [max(0.0, min(1.0, sims[i])) ** quality.POWER for i in best]
        want = sum(w * model.labels[i] for w, i in zip(weights, best, strict=True)) / sum(weights) if sum(weights) else model.prior
        assert abs(score - want) < 1e-3


def test_labels_of_held_out_rows_are_never_read(spark, make):
    from stratalens.llm import quality

    docs = make([(i, "good words here" if i % 2 else "#$ %% !!") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, score_documents(docs, x).collect())) for x in (labels, flipped))
    assert a == b
    twice = docs.union(make([(1, "other text"), (1, "more")]))
    assert score_documents(twice, labels).count() == 62


# SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_golay_code_is_perfect():
    parity, lead, offsets = _golay()
    assert (lead >= 0).all() and ((offsets >= 0).sum(1) == 6).sum() == 1771


@pytest.mark.parametrize("bits", range(5))
def test_golay_keys_meet_within_four_bits(bits):
    rng = np.random.default_rng(bits)
    a = rng.integers(0, 2**64, 300, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for p in rng.choice(64, bits, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(p)
    sets = []
    for x in (a, b):
        k, r = keys_of(x)
        s = defaultdict(set)
        for key, row in zip(k.tolist(), r.tolist(), strict=True):
            s[row].add(key)
        sets.append(s)
    assert all(sets[0][i] & sets[1][i] for i in range(len(a)))


def test_long_runs_give_the_same_components():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 4, dtype=np.uint64)
    fp = np.array([base[i % 4] ^ (np.uint64(1) << np.uint64(i % 60)) for i in range(240)])
    pairs = bucket_links(np.zeros(240, np.int64), fp)
    got = brute_components(dict(enumerate(sorted(set(fp.tolist())))))
    assert len(set(got.values())) == len(set(map(int, np.unique(fp)))) - len(pairs)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aBc \t\n\x0b\x1c é", max_size=30))
def test_fingerprint(text):
    assert fingerprint(text) == brute_fingerprint(text)


def test_simhash_query(spark, sf, texts):
    fps = {k: brute_fingerprint(t) for k, t in texts.items()}
    want = brute_components(fps)
    for r in queries.op5_simhash(spark, sf).collect():
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_simhash_edges(make):
    base = prose(300)
    rows = [(9, None), (8, ""), (7, base), (6, base), (5, base + " x"), (4, "a"), (4, "a"), (3, prose(40))]
    got = simhash_dedup(make(rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and by[9].component_id == by[8].component_id == 8 and by[9].fingerprint == "0" * 16
    assert by[7].component_id == by[6].component_id == by[5].component_id == 5 and by[5].kept
    assert simhash_dedup(make([])).collect() == []


# Shingles


def test_near_copies_against_brute_force(make):
    rng = random.Random(3)
    base = [prose(rng.randint(30, 120), rng).split() for _ in range(12)]
    docs = {}
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "other"
        docs[i] = " ".join(w)
    docs |= {200: None, 201: "", 202: "a b", 203: "A  b"}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, t in docs.items() for w in [(t or "").lower().split()]}
    root = {i: i for i in docs}
    for a in docs:
        for b in docs:
            if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    got = drop_near_copies(make(list(docs.items()))).collect()
    assert {r.doc_id: r.text for r in got} == {i: docs[i] for i, r in root.items() if r == i}
    assert 20 < len(got) < 110


def test_near_copies_are_told_apart_by_text(make):
    x, y, z = (prose(60) for _ in range(3))
    got = drop_near_copies(make([(None, x), (None, y), (None, y), (5, z), (5, x)])).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("None", y), ("5", z), ("5", x)])
    assert drop_near_copies(make([])).collect() == []


# Lines


def distance_at_most(a, b, k):
    if abs(len(a) - len(b)) > k:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        if min(now) > k:
            return False
        row = now
    return row[-1] <= k


def brute_lines(docs, k=2, least=20):
    at = [(i, n, x.strip(" ")) for i, t in docs.items() for n, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    first = {}
    for i, n, x in sorted(at):
        first.setdefault(x, (i, n))
    long = sorted((x for x in first if len(x) >= least), key=len)
    near = defaultdict(set)
    for i, a in enumerate(long):
        for b in long[i + 1 :]:
            if len(b) - len(a) > k:
                break
            if distance_at_most(a, b, k):
                near[a].add(b)
                near[b].add(a)
    out = set()
    for i, n, x in at:
        keeps = min([first[x], *(first[y] for y in near[x])])
        if (i, n) > keeps:
            out.add((i, n, *keeps, (i, n) > first[x], len(near[x])))
    return out


def edited(line, rng, edits):
    s = list(line)
    for _ in range(edits):
        i, kind = rng.randrange(len(s)), rng.randrange(3)
        if kind == 0:
            s[i] = "Z"
        elif kind == 1:
            s.insert(i, "Y")
        else:
            del s[i]
    return "".join(s)


def test_lines_against_brute_force(make):
    rng = random.Random(5)
    base = [prose(rng.randint(3, 12), rng) for _ in range(40)]
    docs = {i: "\n".join(edited(rng.choice(base), rng, rng.randint(0, 4)) if rng.random() < 0.6 else prose(4, rng) for _ in range(rng.randint(1, 8))) for i in range(60)}
    docs |= {100: None, 101: "", 102: "\n\n", 103: " short \nshort", 104: "short"}
    got = {(r.doc_id, r.line_no, r.first_doc_id, r.first_line_no, r.exact, r.n_links) for r in repeated_lines(make(list(docs.items()))).collect()}
    assert got == brute_lines(docs)
    assert len(got) > 50
    kept = {r.doc_id: r.text for r in drop_repeated_lines(make(list(docs.items()))).collect()}
    gone = {x[:2] for x in got}
    for i, t in docs.items():
        assert kept[i] == (t and "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone))


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_of_all_lengths_against_brute_force(make, edits):
    rng = random.Random(edits)
    sizes = [20, 21, 22, 23, 24, 31, 32, 33, 62, 63, 64, 65, 66, 126, 128, 129, 255, 256, 257, 258, 300, 513]
    docs = {}
    for i, n in enumerate(sizes * 3):
        base = "".join(rng.choices("abcdefgh é", k=n - 2)).strip()
        docs[i] = "\n".join("x" + edited(base, rng, k) + "y" for k in (0, 1, edits, edits, edits + 1))
        docs[i] += "\n" + "x" + base[: len(base) // 3] + "\n" + "zz" + base + "zz"
    got = {(r.doc_id, r.line_no, r.first_doc_id, r.first_line_no, r.exact, r.n_links) for r in repeated_lines(make(list(docs.items())), edits).collect()}
    assert got == brute_lines(docs, edits)
    assert sum(not x[4] for x in got) > 60


def test_line_query_against_brute_force(spark, make):
    """The query's own operator over whole documents, a word of some lines changed."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).collect()}
    rng = random.Random(1)
    for i, t in list(docs.items())[:60]:
        docs[100_000 + i] = "\n".join(edited(x, rng, rng.randint(0, 3)) if x.strip() else x for x in t.split("\n"))
    got = {(r.doc_id, r.line_no, r.first_doc_id, r.first_line_no, r.exact, r.n_links) for r in repeated_lines(make(list(docs.items()))).collect()}
    assert got == brute_lines(docs)
    assert sum(not x[4] for x in got) > 20


def test_lines_edges(make):
    assert repeated_lines(make([])).collect() == []
    assert repeated_lines(make([(1, None), (2, "")])).collect() == []
    again = repeated_lines(make([(1, "x" * 30), (1, "x" * 30)])).collect()
    assert again == []
    assert drop_repeated_lines(make([(1, "a"), (2, "a")])).columns == make([]).columns


# Decontamination


def test_planted_templates(spark, make):
    """Items with other numbers and names, put in for them one to one, are found; texts with other words are not."""
    rng = random.Random(11)
    names = ["Alice", "Bob", "Carol", "Dave", "Erin", "Frank", "Grace", "Heidi"]
    items, docs, want = [], [], set()
    for i in range(30):
        shape = [rng.choice(["w", "w", "w", "w", "n", "p"]) if k % 3 == 1 else "w" for k in range(rng.randint(16, 40))]
        words, slots = [rng.choice(VOCABULARY) for _ in shape], [rng.randrange(4) for _ in shape]
        numbers, people = rng.sample(range(2, 900), 8), rng.sample(names, 8)
        fill = lambda at, ws: " ".join(w if s == "w" else str(numbers[at + x]) if s == "n" else people[at + x] for w, s, x in zip(ws, shape, slots, strict=True))  # noqa: B023, E731
        items.append((i, fill(0, words)))
        other = [w if k % 4 else rng.choice(VOCABULARY) + "q" for k, w in enumerate(words)]
        frame = lambda t: prose(rng.randint(0, 30), rng) + " and " + t + " so " + prose(rng.randint(0, 30), rng)
        docs += [(100 * i, frame(fill(0, words))), (100 * i + 1, frame(fill(4, words))), (100 * i + 2, frame(fill(0, other)))]
        want |= {(100 * i, i), (100 * i + 1, i)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination(make(docs), bench).collect()}
    assert got == want


def test_rows_are_judged_by_their_texts(spark, make):
    item = prose(20)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = make([(None, item), (None, prose(30)), (7, "x " + item), (7, prose(40)), (8, None)])
    assert sorted((str(r.doc_id), (r.text or "").startswith("x ")) for r in drop_contaminated(docs, bench).collect()) == [("7", False), ("8", False), ("None", False)]


def test_contamination_of_a_very_long_text(spark, make):
    item = prose(30)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = contamination(make([(1, prose(60_000) + " " + item + " " + prose(60_000))]), bench).collect()
    assert [(r.doc_id, r.coverage) for r in got] == [(1, 1.0)]


def test_contamination(spark, make):
    item = "In the year 1998 farmer Bob sold 35 apples to Alice for 7 dollars and then walked home to the village by the river"
    other = item.replace("1998", "2004").replace("Bob", "Tom").replace("35", "81").replace("Alice", "Eve").replace("7 dollars", "9 dollars")
    mixed = "Of two farmers Bob sold apples to Alice and then Bob and Alice walked home together along the quiet river before dinner"
    broken = mixed.replace("then Bob and Alice", "then Tom and Eve")
    bench = spark.createDataFrame([(1, item), (2, mixed), (3, None), (4, "too short"), (5, "one two three four five six")], "item_id long, text string")
    docs = [(10, prose(50) + ". " + item + ". " + prose(50)), (11, other), (12, broken), (13, prose(200)), (14, None), (15, ""), (16, item), (16, item), (17, "zero one two three four five six seven")]
    got = {(r.doc_id, r.item_id): r for r in contamination(make(docs), bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (16, 1), (17, 5)}
    assert got[11, 1].changed >= 4 and got[16, 1].changed == 0
    assert contamination(make([]), bench).collect() == [] and contamination(make(docs), bench.where("false")).collect() == []
    assert sorted(r.doc_id for r in drop_contaminated(make(docs), bench).collect()) == [12, 13, 14, 15]


def test_contamination_query(spark, sf, texts):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in texts.items() for i, b in bench if b in t}
    got = {(r.doc_id, r.item_id) for r in queries.op6_decontaminate(spark, sf).collect()}
    assert want and got == want


def test_contamination_run_beside_a_changed_word(spark, make):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    part = [*words[:20], "other", *words[21:31]]
    got = contamination(make([(10, " ".join(part)), (11, " ".join(words[:12]))]), bench).collect()
    assert [(r.doc_id, r.n_windows, r.item_windows, r.run) for r in got] == [(10, 16, 52, 20)]


def test_contamination_with_slots_at_odds(spark, make):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]

    def text(**at):
        return " ".join(at.get(f"i{i}", w) for i, w in enumerate(words))

    bench = spark.createDataFrame([(1, text(i10="3", i30="3")), (2, text(i5="6", i33="7").replace("w", "v"))], "item_id long, text string")
    docs = [(10, text(i10="3", i30="4")), (11, text(i5="5", i33="5").replace("w", "v")), (12, text(i10="3", i30="3"))]
    got = {(r.doc_id, r.item_id): r for r in contamination(make(docs), bench).collect()}
    assert set(got) == {(10, 1), (11, 2), (12, 1)}
    assert (got[10, 1].n_windows, got[10, 1].run) == (25, 30) and got[11, 2].run == 33 and got[12, 1].coverage == 1


def test_contamination_by_verbatim_copies_of_any_item(spark, make):
    items = {1: "Compute 12 * 13 + 7", 2: "Sort 3 9 4 1 5 8 2 7 6 0", 3: "Ann, Bob, Carl, Dora, Eve, Fred, Gus, Hal, Ida and Joe", 4: "Name every prime below ten", 5: "Why?", 6: "The Red Fox And The Blue Hen Sat Down By The Old Stone Mill", 7: None, 8: " ", 9: "?!"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = [(10 + i, f"before that, {t} zz") for i, t in items.items() if t] + [(30 + i, f"x {t.lower()}") for i, t in items.items() if t] + [(50 + i, f"x {t.upper()} X") for i, t in items.items() if t]
    got = {(r.doc_id, r.item_id): r for r in contamination(make(docs), bench).collect()}
    assert set(got) == {(k + i, i) for k in (10, 30, 50) for i in range(1, 7)}
    assert {(r.coverage, r.changed) for r in got.values()} == {(1.0, 0)}


# Suffixes


def brute_cut(docs, n):
    seen = Counter(t[s : s + n] for _, t in docs for s in range(len(t) - n + 1))
    out = []
    for i, t in docs:
        mark = np.zeros(len(t) + 1, int)
        for s in range(len(t) - n + 1):
            if seen[t[s : s + n]] > 1:
                mark[s] += 1
                mark[s + n] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        raw = np.frombuffer(t, np.uint8)
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
    return sorted(out)


def cut_rows(df):
    return sorted((r.doc_id, r.n_bytes, sum(s.to - s["from"] for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


def test_blocks_partition_starts():
    raw = np.random.default_rng(0).integers(97, 100, 3000, dtype=np.uint8)
    first, count, anchor, _, _ = blocks_of(raw)
    assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == 3000 - 399
    assert (anchor >= first + count - 1).all() and (anchor <= first + 368).all()


def test_suffixes_against_brute_force(make):
    rng = random.Random(11)
    passages = [prose(90, rng) for _ in range(4)]
    docs = []
    for i in range(24):
        parts = [prose(rng.randint(0, 60), rng)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 120)
            parts += [p[a : a + rng.randrange(300, 560)], prose(rng.randint(0, 30), rng)]
        docs.append((i, " ".join(parts)))
    docs += [(50, "ab" * 700), (51, "z" * 399), (52, "z" * 399), (53, "q" * 400), (54, "q" * 400), (55, "w" * 401), (56, ""), (57, None), (58, docs[3][1]), (58, docs[3][1])]
    want = brute_cut([(i, (t or "").encode()) for i, t in docs], 400)
    assert cut_rows(cut_repeats(make(docs))) == want
    assert sum(x[2] for x in want) > 1000


def test_suffix_query(spark, sf, texts):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op8_suffixes(spark, sf).collect())
    assert got == brute_cut([(i, t.encode()) for i, t in texts.items()], 400)


def test_suffixes_of_an_empty_table(make):
    assert cut_repeats(make([])).collect() == []


# Quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op1_quality(spark, sf).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_quality_edges(spark, make):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, None), (3, 1, None), (99, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    docs = make([(1, prose(60)), (2, "!!! ### $$$ " * 20), (3, prose(80)), (5, None), (6, ""), (7, "a"), (7, "a"), (8, "*** !!! " * 200_000)])
    rows = score_documents(docs, labels).collect()
    assert len(rows) == 8 and all(r.score is not None for r in rows)
    assert score_documents(make([]), labels).collect() == []
    assert {r.score for r in score_documents(docs, labels.where("false")).collect()} == {0.5}
    assert keep_good(docs, labels).columns == docs.columns
