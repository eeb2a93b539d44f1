"""The filter audit, best-fit packing, the replay of conversations, and numbers within groups."""

import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalens.llm import queries
from stratalens.llm.filter_audit import audit_documents, count_block, interaction_audit, prefixes, text_flags, with_labels
from stratalens.llm.fitting import ChunkEncoder, Places, Planner, fit_documents, plan
from stratalens.llm.release import attempt, replay
from stratalens.llm.running import numbered

PATH = public_tokenizers.path("word_bpe_49k.json")


# Numbers within groups


def test_numbered_against_brute_force(spark):
    """One group holds most rows, and many rows are equal, so groups and ties span tasks."""
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.7 else rng.randrange(40), rng.randrange(30) if i % 3 else 7, rng.randrange(1 << 32)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(5)
    got = numbered(df, "k", ["o", "v"], "v").collect()
    want, n, total = [], Counter(), Counter()
    for k, o, v in sorted(rows):
        n[k] += 1
        total[k] += n[k] * v
        want.append((k, o, v, n[k], total[k]))
    assert sorted(tuple(map(int, r)) for r in got) == want
    plain = numbered(df.select("k", "o"), "k", ["o"]).collect()
    assert sorted((r.k, r.nth) for r in plain) == sorted((w[0], w[3]) for w in want)
    assert numbered(df.where("k < 0"), "k", ["o"], "v").collect() == []


# The filter audit


def brute_audit(fails, parts, good, toxic):
    """fails: a set of letters for each document."""
    out, removed_in = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in set(parts):
            here = [i for i in range(len(fails)) if parts[i] == part]
            for step, letter in enumerate(order, 1):
                gone = [i for i in here if letter in fails[i]]
                stays = [i for i in here if not fails[i] & set(order[: step - 1])]
                removed = [i for i in stays if letter in fails[i]]
                out[part, order, step] = [len(stays) - len(removed), len(removed), len(gone) - len(removed), sum(fails[i] == {letter} for i in here), sum(i in good for i in removed), sum(i in toxic for i in removed)]
                removed_in[part, letter] += len(removed)
    return {k: (*v, removed_in[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def brute_flags(docs):
    """docs: (doc_id, text, part)."""
    out = []
    for i, text, _ in docs:
        t = text or ""
        words = [w for w in t.encode().split() if w]
        least = min((j for j, u, _ in docs if j is not None and (u or "") == t), default=None)
        checks = [
            ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)),
            ("D", any(c in "#$%&*|" for c in t)), ("E", i is not None and least is not None and i > least),
        ]
        out.append({k for k, x in checks if x})
    return out


EDGE = [
    (1, None, "en"), (2, "", "en"), (3, "", None), (None, "", "en"), (None, None, "de"), (4, "AB cd\x1fef gh\x0bij", "de"), (5, "AB cd\x1fef gh\x0bij", "en"), (5, "AB cd\x1fef gh\x0bij", "en"),
    (6, "a|b", "fr"), (7, " ".join(f"w{i}" for i in range(100)), "fr"), (8, " ".join(f"w{i}" for i in range(99)), "fr"), (9, " ".join(f"w{i % 80}" for i in range(100)), "fr"), (10, " ".join(f"w{i % 79}" for i in range(100)), "fr"),
    (11, "Äbcdefghij" * 3, ""), (12, "Abcdefghiä", ""), (13, "ABcdefghiä", ""), (14, "x " * 200_000, "es"), (15, "word " * 3 + "#", "es"),
]


def test_flags_and_audit_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, p, "x", True, 3) for i, t, p in EDGE], "doc_id long, text string, lang string, digest string, A boolean, good int")
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, None), (8, 1, 1), (9, None, 1), (99, 1, 1), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    flags = brute_flags(EDGE)
    got = Counter((r.doc_id, r.part, "".join(c for c in "ABCDE" if r[c])) for r in text_flags(docs).collect())
    assert got == Counter((i, p or "", "".join(sorted(f))) for (i, _, p), f in zip(EDGE, flags, strict=True))
    parts = [p or "" for *_, p in EDGE]
    good, toxic = ({i for i, d in enumerate(EDGE) if d[0] in ids} for ids in ({5, 8}, {8, 9}))
    rows = audit_documents(docs, labels).collect()
    told = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(rows) == len(told) == 600 * len(set(parts)) and told == brute_audit(flags, parts, good, toxic)
    assert audit_documents(docs.where("false"), labels).collect() == []
    assert {r.good_lost for r in audit_documents(docs, labels.where("false")).collect()} == {0}


def test_audit_of_other_filters(spark):
    """Any one-letter filters and labels; many parts in a task, some of them in several."""
    rng = random.Random(8)
    rows = [(f"p{rng.randrange(150)}", rng.random() < 0.5, rng.random() < 0.3, rng.random() < 0.1) for _ in range(2000)]
    df = spark.createDataFrame(rows, "part string, x boolean, y boolean, seen boolean").repartition(3)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.seen_lost) for r in interaction_audit(df, "xy", ("seen",)).collect()}
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        left = [r for r in here if not r[2]]
        both = [r for r in left if not r[1]]
        assert got[part, "yx", 1] == (len(left), len(here) - len(left), sum(r[3] for r in here if r[2]))
        assert got[part, "yx", 2] == (len(both), len(left) - len(both), sum(r[3] for r in left if r[1]))
    assert len(got) == 4 * len({r[0] for r in rows})
    with pytest.raises(ValueError):
        interaction_audit(df, "xx")


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 200), st.integers(1, 4), st.integers(0, 1 << 30))
def test_block_counts(n, filters, seed):
    rng = np.random.default_rng(seed)
    fails, labels, codes = rng.random((n, filters)) < 0.4, rng.random((n, 2)) < 0.5, rng.integers(0, 3, n)
    got = count_block(fails, labels, codes[:, None] == np.arange(3))
    for k, (s, f) in enumerate(prefixes(filters)):
        early = fails[:, [i for i in range(filters) if s >> i & 1]].any(1)
        for p in range(3):
            here, hit = codes == p, ~early & fails[:, f]
            want = [here & ~early & ~fails[:, f], here & hit, here & early & fails[:, f], here & hit & labels[:, 0], here & hit & labels[:, 1]]
            assert got[p, k].tolist() == [int(w.sum()) for w in want]


def test_audit_query(spark, sf, duck):
    want = duck.sql(queries.oracle_sql()["op11_filter_audit"])
    got = queries.queries()["op11_filter_audit"](spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# Best-fit packing


def used(patterns):
    out = Counter()
    for pieces, times in patterns:
        for n in pieces:
            out[n] += times
    return out


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plans_place_all_pieces(counts):
    patterns = plan(counts, 64)
    assert used(patterns) == Counter(counts) and all(sum(p) <= 64 and k > 0 for p, k in patterns)
    plain = Planner(counts, 64)
    plain.best_fit()
    windows = sum(k for _, k in patterns)
    assert windows >= -(-sum(n * k for n, k in counts.items()) // 64)
    assert windows <= sum(k for _, k in plain.patterns) + 2  # no worse than best fit alone
    places, seen = Places(patterns), Counter()
    spans = []
    for n, k in counts.items():
        sequence, offset = places.find(np.full(k, n), np.arange(k))
        spans += zip(sequence.tolist(), offset.tolist(), [n] * k, strict=True)
    for s, at, n in sorted(spans):
        assert at == seen[s]
        seen[s] += n
    assert sorted(seen) == list(range(windows))


def test_complements():
    """Exact fills of one, two and three pieces, under the counts there are."""
    assert used(plan({60: 2, 40: 2}, 100)) == {60: 2, 40: 2} and len(plan({60: 2, 40: 2}, 100)) == 1
    planner = Planner({50: 1, 30: 1, 20: 1}, 100)
    assert planner.complement(50) == (50,) and planner.complement(80) == (50, 30) and planner.complement(100) == (50, 30, 20)
    assert planner.complement(60) is None and planner.complement(40) is None  # one 20 and one 30 at hand
    assert planner.complement(80, 1) is None and planner.complement(0) == ()
    assert sum(k for _, k in plan({700: 1000}, 2048)) == 500


def test_ids_against_the_tokenizer():
    encoder = ChunkEncoder(PATH, 50)
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'S", "'ve", "a", "B", "é", "É", "é", "ß", "İ", "µ", "ª", "½", "1", "23", "!", ".", ",", "#$", "<|endoftext|>", "<|", "日本", "ﬁ", "​", "Σ", "ς", "ΑΣ", "😀", "\x00", "\xad", "ñ", "Ñ", "it's,", "word."]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(4000)] + ["", "Hello, WORLD's 123 naïve Straße."]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def check_fit(rows, docs, window):
    """docs: texts by id, each once or more; ids of rows with ids are the tokenizer's, and windows are gapless."""
    tokenizer = ChunkEncoder(PATH).tokenizer
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(windows) == list(range(len(windows)))
    told = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), window)):
            part = ids[start : start + window]
            want[doc, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert told == want
    return len(windows)


def test_fit_documents(spark, make):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "x", "1"], k=rng.randrange(60)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, " \n "), (None, "no id"), (None, "no id"), (7, docs[7][1]), (503, "word " * 3000), (504, "<|endoftext|> " * 40)]
    rows = fit_documents(make(docs).repartition(4), PATH, window=64).collect()
    n = check_fit(rows, docs, 64)
    assert n <= -(-sum(r.length for r in rows) // 64) + 2
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert fit_documents(make([]), PATH).collect() == []


def test_fit_query(spark, sf):
    rows = queries.queries()["op12_fitting"](spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, total = check_fit(rows, docs, 2048), sum(r.length for r in rows)
    assert n <= -(-total // 2048) * 1.02 + 1


# The replay of conversations


def brute_replay(rows):
    """rows: (conv_id, turn, text), none of the first two null."""
    out, by = [], {}
    for c, t, x in rows:
        by.setdefault(c, []).append((t, zlib.crc32((x or "").encode())))
    for c, turns in by.items():
        turns.sort()
        h = lambda k, t, c=c: zlib.crc32(f"{k}:{c}:{t}".encode())
        told = []
        for p, (t, _) in enumerate(turns):
            back = h(0, t) % 7
            parent = told[p - back] if back and p >= back else None
            if parent and parent[0] != "delivered":
                told.append(("blocked", 0, None, None))
                continue
            first = at = max(7 * p, parent[3]) if parent else 7 * p
            faulty, repaired, a = h(1, t) % 101 < 20, 7 * p + h(2, t) % 101, 1
            while faulty and (at < repaired or h(a + 2, t) % 3 == 0) and a < 4:
                at, a = at + 20 * 2 ** (a - 1), a + 1
            failed = faulty and (at < repaired or h(a + 2, t) % 3 == 0)
            told.append(("dead" if failed else "delivered", a, first, at))
        order = sorted((told[p][3], turns[p][0], p) for p in range(len(turns)) if told[p][0] == "delivered")
        number, state = {}, 0
        for i, (*_, p) in enumerate(order, 1):
            state += i * turns[p][1]
            number[p] = i, state
        out += [(c, turns[p][0], *told[p], *number.get(p, (None, None))) for p in range(len(turns))]
    return Counter(out)


def replayed(df):
    return Counter((r.conv_id, r.turn, r.status, r.attempts, r.first_at, r.last_at, r.release_no, r.state if r.state is None else int(r.state)) for r in df.collect())


def test_replay_against_brute_force(spark):
    """One conversation holds most turns; turns are missing, repeated and out of order."""
    rng = random.Random(5)
    rows = [(1, t, f"text {t}") for t in range(900)] + [(c, t, rng.choice([None, "", "x", "é" * 9])) for c in range(2, 60) for t in rng.sample(range(30), 9)]
    rows += [(1, 5, "text 5"), (1, 5, "other"), (-4, -3, "minus"), (-4, 10**12, None)]
    rng.shuffle(rows)
    lost = [(None, 1, "a"), (2, None, "b"), (None, None, None), (None, 1, "a")]
    df = spark.createDataFrame([(*r, "u", 0, None) for r in rows + lost], "conv_id long, turn long, text string, role string, p int, status string").repartition(6)
    want = brute_replay(rows) + Counter((*r[:2], *[None] * 6) for r in lost)
    got = replayed(replay(df))
    assert got == want and {r[2] for r in got} == {"delivered", "dead", "blocked", None}
    assert replay(df.where("false")).collect() == []
    assert {r.state for r in replay(df.where("conv_id is null")).collect()} == {None}


def test_attempts():
    assert attempt(3, None, 15, 0) == ("delivered", 1, 21, 21) and attempt(3, None, 15, 50) == ("delivered", 1, 50, 50)
    assert attempt(0, 100, 0, -1) == ("blocked", 0, None, None)
    assert attempt(0, 100, 0, 0) == ("delivered", 4, 0, 140) and attempt(0, 100, 8, 0) == ("dead", 4, 0, 140)
    assert attempt(0, 60, 0, 0) == ("delivered", 3, 0, 60) and attempt(0, 10, 1, 10) == ("delivered", 2, 10, 30)


def test_replay_query(spark, sf):
    rows = [(r.conv_id, r.turn, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert replayed(queries.queries()["op13_release"](spark, sf)) == brute_replay(rows)


def test_labels_are_whole(spark):
    flags = spark.createDataFrame([(1, "en"), (None, "en")], "doc_id long, part string")
    labels = spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int")
    got = with_labels(flags, labels).orderBy(F.col("doc_id").isNull()).collect()
    assert [tuple(r) for r in got] == [(1, "en", True, False), (None, "en", False, False)]
