"""Near-duplicates, leaks, tokens and quotas against brute force."""

import random
import tempfile
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizlake.llm import leaks, neardup, quota, tokens
from quizlake.llm.transducer import Lexicon, compile_lexicon
from quizlake.session import stage


def corpus(kind, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range({"dense": 60, "sparse": 4000, "mixed": 300}[kind])]
    out = []
    for _ in range(250):
        n = rng.choice([1, 2, 3, 5, 9, 14, 22, 40, 55])
        out.append({words[int(len(words) * rng.random() ** 2)] for _ in range(n)})
    for s in out[:120]:
        t = set(s)
        for _ in range(rng.randrange(0, max(1, len(s) // 4) + 1)):
            t.discard(rng.choice(sorted(s)))
            if rng.random() < 0.6:
                t.add(rng.choice(words))
        out.append(t)
    base = {f"x{i}" for i in range(1500)}
    out += [base, base | {f"y{i}" for i in range(200)}, set()]
    return sorted({frozenset(s) for s in out}, key=lambda s: (len(s), sorted(s)))


@pytest.mark.parametrize("kind", ["dense", "sparse", "mixed"])
@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 1.0])
def test_similar_sets_misses_no_pair(spark, kind, threshold):
    sets = corpus(kind, 7)
    ids = {w: i * 2654435761 % 2**63 - 2**62 for i, w in enumerate(sorted(set().union(*sets)), 1)}
    rows = [(i, sorted(ids[w] for w in s)) for i, s in enumerate(sets)]
    got = {(r["a"], r["b"]) for r in neardup.similar_sets(stage(spark.createDataFrame(rows, "id long, w array<bigint>"), "sets"), threshold).collect()}
    want = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if b and a and len(a & b) >= threshold * len(a | b) - 1e-9}
    assert got == want


@pytest.mark.parametrize("most", [0, 5, 60])
def test_more_common_words_than_are_held(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "MOST_COMMON", most)
    sets = corpus("mixed", 11)
    ids = {w: i * 2654435761 % 2**63 - 2**62 for i, w in enumerate(sorted(set().union(*sets)), 1)}
    rows = [(i, sorted(ids[w] for w in s)) for i, s in enumerate(sets)]
    got = {(r["a"], r["b"]) for r in neardup.similar_sets(stage(spark.createDataFrame(rows, "id long, w array<bigint>"), "sets"), 0.7).collect()}
    assert got == {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if b and a and len(a & b) >= 0.7 * len(a | b) - 1e-9}


def test_a_plan_takes_little_of_the_driver_whatever_the_words(spark, monkeypatch):
    monkeypatch.setattr(neardup, "RARE_SETS", 0)
    sets = stage(spark.range(6000).selectExpr("id", "array_sort(transform(sequence(1, 50), j -> xxhash64(id, j))) as w"), "sets")
    tracemalloc.start()
    try:
        plan, _ = neardup.make_plan(sets, 0.7)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(plan.common) == 300_000 and peak < 150e6  # a cell for every sampled set and word would take 1,200 MB


def test_the_commonest_words_are_held(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MOST_COMMON", 7)
    counts = [30] * 3 + [29] * 4 + [28] * 5
    rows = [(i, [w for w, n in enumerate(counts) if i < n]) for i in range(40)]
    plan, known = neardup.make_plan(stage(spark.createDataFrame(rows, "id long, w array<bigint>"), "sets"), 0.7)
    assert plan.common.tolist() == list(range(7)) and not any(x for r in known.collect() for x in r["raras"])


def test_a_record_of_very_many_words(spark):
    base = np.arange(100_000, dtype=np.int64) * 7919
    rows = [(i, sorted(x)) for i, x in enumerate((base.tolist(), base[:-9000].tolist(), base[50_000:].tolist(), [1, 2, 3]))]
    rows += [(10 + i, base[i * 900 : i * 900 + 1000].tolist()) for i in range(30)] * 1
    got = {(r["a"], r["b"]) for r in neardup.similar_sets(stage(spark.createDataFrame(rows, "id long, w array<bigint>"), "sets"), 0.8).collect()}
    assert got == {(0, 1)}


def test_allocation_in_blocks_is_enough(monkeypatch):
    rng = np.random.default_rng(4)
    p0 = rng.random((6, 40))
    p1, need = p0 + rng.random((6, 40)), rng.integers(1, 80, 6)
    whole = neardup._allocate(need, p0, p1)
    monkeypatch.setattr(neardup, "_BLOCK", 7)
    got = neardup._allocate(need, p0, p1)
    assert ((got + 1).sum(1) >= need).all() and ((whole + 1).sum(1) >= need).all() and got.min() >= -1 and got.max() <= 1


def test_allocation_is_enough_and_cheapest():
    rng = np.random.default_rng(3)
    from itertools import product

    for _ in range(20):
        p0 = rng.random((4, 5))
        p1 = p0 + rng.random((4, 5))
        need = rng.integers(1, 10, 4)
        got = neardup._allocate(need, p0, p1)
        for r in range(4):
            price = lambda t: sum((0, p0[r, i], p1[r, i])[x + 1] for i, x in enumerate(t))  # noqa: B023, E731
            assert (got[r] + 1).sum() >= need[r]
            best = min(price(t) for t in product((-1, 0, 1), repeat=5) if sum(x + 1 for x in t) >= need[r])
            assert abs(price(got[r]) - best) < 1e-9


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    from quizlake.functions.matching import DisjointSets

    s = DisjointSets()
    for a, b in edges:
        s.join(a, b)
    want = {x: s.find(x) for x in s.parent}
    got = {r["node"]: r["grupo"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def bank(spark, rows):
    return spark.createDataFrame(rows, "num long, enunciado string, opciones map<string,string>")


def test_copies_take_part_once_and_are_expanded(spark):
    text = " ".join(f"palabra{i}" for i in range(20))
    rows = [(i, text if i % 2 else text.upper() + "!", {"a": "x"}) for i in range(40)] + [(100, text + " otra", {"a": "x"}), (101, " ".join(reversed(text.split())), {"a": "x"}), (102, None, None), (103, None, {})]
    got = {tuple(r) for r in neardup.revised_questions(bank(spark, rows), 0.7).collect()}
    assert got == {(i, j) for i in range(40) for j in (100, 101)} | {(100, 101)}
    groups = {r["num"]: (r["grupo"], r["enlaces"]) for r in neardup.question_groups(bank(spark, rows), 0.7).collect()}
    assert all(groups[i] == (0, 2) for i in range(40)) and groups[100] == (0, 2) and groups[101] == (0, 2) and groups[102][1] == 0


def test_leaks_are_all_runs(spark):
    rng = random.Random(2)
    words = [f"p{i}" for i in range(80)] + ["año", "útil", "80º"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([5, 12, 30, 60])))) for i in range(25)] + [(30, None), (31, "")]
    docs = []
    for d in range(120):
        parts = [" ".join(rng.choice(words + [f"n{j}" for j in range(30)]) for _ in range(rng.randrange(0, 40)))]
        _, text = rng.choice(items[:25])
        w = text.split()
        n = rng.choice([6, 10, 11, 12, 13, 20])
        at = rng.randrange(0, max(1, len(w) - n + 1))
        parts.append(" ".join(w[at : at + n]).upper().replace("Ú", "U"))
        parts.append(rng.choice(["", " ".join(rng.choice(words) for _ in range(9))]))
        docs.append((d, ". ".join(parts)))
    docs += [(500, None), (501, ""), (None, items[3][1])]
    runs = lambda t: {tuple(leaks.words(t)[i : i + 12]) for i in range(len(leaks.words(t)) - 11)}
    want = {(d, i) for d, t in docs for i, s in items if runs(t) & runs(s)}
    got = {tuple(r) for r in leaks.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 20


def test_paraphrases_are_reported(spark):
    core = "el velero azul de doce metros navega hacia la isla verde cuando pierde su ancla dorada cerca del faro viejo"
    item = core + " a) fondear en la cala norte b) llamar al puerto sur"
    changed = "el velero azul de once metros navega rumbo a la isla verde y pierde su ancla dorada junto al faro viejo a) fondear en la cala norte o b) llamar al puerto sur"
    noise = [(i, " ".join(f"ruido{(i * 13 + j) % 400}" for j in range(60)) + " de la el a en") for i in range(60)]
    docs = spark.createDataFrame([(900, changed), (901, core)] + noise, "doc_id long, text string")
    got = {r["doc_id"]: r for r in leaks.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[900]["clase"] == "parafraseada" and got[900]["opciones_halladas"] == 2 and got[901]["clase"] == "literal" and len(got) == 2


def test_paraphrases_with_many_copies_are_reported(spark):
    core = "el velero azul de doce metros navega hacia la isla verde cuando pierde su ancla dorada cerca del faro viejo"
    item = core + " a) fondear en la cala norte b) llamar al puerto sur"
    changed = "el velero azul de once metros navega rumbo a la isla verde y pierde su ancla dorada junto al faro viejo a) fondear en la cala norte o b) llamar al puerto sur"
    noise = [(i, " ".join(f"ruido{(i * 13 + j) % 400}" for j in range(60)) + " de la el a en") for i in range(60)]
    docs = spark.createDataFrame([(900 + i, changed.upper() + "." if i % 2 else changed) for i in range(30)] + noise, "doc_id long, text string")
    got = leaks.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(range(900, 930)) and {r["clase"] for r in got} == {"parafraseada"}


def test_no_paraphrase_of_an_item_without_content_words(spark):
    common = "de la el en que se con por"
    docs = [(i, f"{common} ruido{i}") for i in range(40)]
    assert leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, common)], "item_id long, text string")).count() == 0


def planted(seed, copies):
    """Items of 40 content words with two options, and documents with paraphrases of them: a word in seven exchanged, clauses
    moved, options kept; among documents without any."""
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{i}x" for i in range(3000)]
    small = "de la el en que y a con por".split()
    clause = lambda n: " ".join(w for _ in range(n) for w in (rng.choice(words), rng.choice(small))[: rng.choice([1, 2])])
    items, docs = [], []
    for i in range(40):
        clauses, options = [clause(9) for _ in range(4)], [clause(5) for _ in range(2)]
        items.append((i, ", ".join(clauses) + "? a) " + options[0] + " b) " + options[1]))
        for c in range(copies):
            moved = clauses[:]
            j = rng.randrange(3)
            moved[j], moved[j + 1] = moved[j + 1], moved[j]
            text = [rng.choice(words) if k % 7 == c % 7 else w for k, w in enumerate(" ".join(moved).split())]
            docs.append((1000 + i * copies + c, clause(20) + ". " + " ".join(text) + " a) " + options[0] + " b) " + options[1] + ". " + clause(15)))
    return items, docs + [(i, clause(60)) for i in range(300)]


def test_recall_of_paraphrases(spark):
    items, docs = planted(3, 5)
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, items).collect()}
    want = {(1000 + i * 5 + c, i) for i in range(40) for c in range(5)}
    assert len(got & want) >= 0.9 * len(want) and got <= want
    near = lambda probes: {(r["doc_id"], r["item_id"]) for r in leaks.search(docs, items, leaks.PARAPHRASED, probes=probes).collect()}
    every, some = near(10**6), near(leaks.PROBES)
    assert some <= every and len(some) >= 0.9 * len(every)


def test_blocks_of_items_and_few_slots_give_the_same_runs(spark, monkeypatch):
    items, docs = planted(5, 1)
    docs += [(5000 + i, "Nota: " + " ".join(t.split()[3:20]) + ".") for i, t in items]
    items.append((3, "otro texto de la misma pregunta con doce palabras seguidas y algunas otras más"))
    docs.append((6000, items[-1][1].upper()))
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = {tuple(r) for r in leaks.contained(docs, items).collect()}
    assert want >= {(5000 + i, i) for i in range(40)} | {(6000, 3)}
    monkeypatch.setattr(leaks, "BLOCK_WINDOWS", 200)
    assert {tuple(r) for r in leaks.contained(docs, items).collect()} == want
    monkeypatch.setattr(leaks, "SLOTS", 64)
    assert {tuple(r) for r in leaks.contained(docs, items).collect()} == want


def test_runs_come_through_the_cosine(spark, monkeypatch):
    items, docs = planted(6, 1)
    docs += [(5000 + i, "Nota: " + " ".join(t.split()[3:20]) + ".") for i, t in items]
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = {tuple(r) for r in leaks.contained(docs, items).collect()}
    assert want >= {(5000 + i, i) for i in range(40)}
    with monkeypatch.context() as m:  # the nearest cells have them as well as the codes
        m.setattr(leaks, "_by_code", lambda x, place, at, least=0: iter(()))
        assert {tuple(r) for r in leaks.contained(docs, items).collect()} == want
    monkeypatch.setattr(leaks, "LITERAL", 1.5)  # no cosine is as large
    assert leaks.contained(docs, items).count() == 0


def test_runs_of_words_without_a_latent_vector(spark):
    text = " ".join(f"z{i}" for i in range(14))
    docs = spark.createDataFrame([(1, text)] + [(10 + i, " ".join(f"a{(i + j) % 60}" for j in range(200))) for i in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([(1, text)] + [(2 + i, " ".join(f"a{(i * 7 + j) % 60}" for j in range(30))) for i in range(20)], "item_id long, text string")
    got = leaks.search(docs, items, leaks.LITERAL, rank=1).where("seguidas >= 12")
    assert {tuple(r) for r in got.where("doc_id = 1").select("doc_id", "item_id").collect()} == {(1, 1)}


def test_words_are_hashed_alike_in_both_places(spark):
    texts = ["¿Qué Año?", "ÑANDÚ e\u0301l 3º 40,5", "ΣΑΣ Ĳ ǅ İstanbul", "", None, "x" * 500, "海は 静か"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(leaks.word_hashes(F.col("t"))).collect()
    assert [r[0] for r in got] == [leaks._hashed(leaks.words(t)).tolist() for t in texts]


def test_lcs():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.integers(0, 6, rng.integers(0, 30)), rng.integers(0, 6, rng.integers(0, 30))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert leaks._lcs(a, b) == t[-1, -1]


RANKS = tokens.read_ranks(open(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}", "rb").read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_merging_is_the_librarys(text):
    from tokenizers import Tokenizer

    global _LIBRARY
    if "_LIBRARY" not in globals():
        _LIBRARY = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
        _LIBRARY.encode_special_tokens = True
    try:
        want = _LIBRARY.encode(text, add_special_tokens=False).ids
    except UnicodeEncodeError:  # half a surrogate pair
        return
    assert tokens.Encoder(RANKS, None).encode([text])[0].as_py() == want


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(max_size=6), st.lists(st.integers(0, 50_000), max_size=4), max_size=40), st.lists(st.binary(max_size=7), max_size=20))
def test_transducer_round_trip(entries, others):
    with tempfile.NamedTemporaryFile() as f:
        f.write(compile_lexicon(entries))
        f.flush()
        lexicon = Lexicon(f.name)
        words = [*entries, *others]
        for word, place in zip(words, lexicon.places(words)):
            assert (lexicon.output(place) if place >= 0 else None) == (entries.get(word) if word else None)


def test_transducer_is_minimal():
    entries = {w.encode(): [i] for i, w in enumerate(["navegaremos", "fondearemos", "gobernaremos", "navego"])}
    with tempfile.NamedTemporaryFile() as f:
        f.write(compile_lexicon(entries))
        f.flush()
        assert len(Lexicon(f.name).finals) < 25  # the endings are shared


def test_totals_count_every_row(spark, library):
    rows = [(1, "hola mundo", "x"), (1, "hola mundo", "x"), (None, "una frase", "y"), (2, None, None), (3, "", "y")]
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = {r["source"]: (r["documentos"], r["tokens"]) for r in tokens.totals(spark.createDataFrame(rows, "doc_id long, text string, source string"), "source").collect()}
    assert got == {"x": (2, 2 * n("hola mundo")), "y": (2, n("una frase")), None: (1, 0)}


def test_ids_with_and_without_lexicon(spark, library):
    texts = ["El patrón gobernará a 350º… ¡ya!", "", None, " ", "<|endoftext|> x", "a" * 500, "  dos\n\n\tespacios ", "海は静か", "👍🏽"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (0, 5, 1000):
        got = {r["doc_id"]: r["ids"] for r in tokens.encode(docs, lexicon_words=size).collect()}
        assert [got[i] for i in range(len(texts))] == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.lists(st.integers(0, 20), min_size=4, max_size=4)), min_size=1, max_size=7))
def test_controlled_rounding_keeps_both_margins(rows):
    totals, table = [], []
    for take, have in rows:
        there = sum(have)
        take = min(take, there)
        totals.append(take)
        table.append([h * take / there if there else 0.0 for h in have])
    got = quota.controlled_rounding(table, totals)
    assert [sum(r) for r in got] == totals
    assert all(abs(g - x) < 1 + 1e-9 for gr, xr in zip(got, table) for g, x in zip(gr, xr))
    assert all(abs(sum(g[j] for g in got) - sum(x[j] for x in table)) < 1 + 1e-6 for j in range(4))
    assert all(g <= h for gr, (_, hr) in zip(got, rows) for g, h in zip(gr, hr))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just(0.0), st.floats(1e-6, 1)), st.integers(0, 9), st.lists(st.integers(0, 20), min_size=3, max_size=3)), min_size=1, max_size=7), st.integers(0, 200))
def test_sizes_are_shared_out_and_rounded(rows, size):
    share, least, have = [r[0] for r in rows], [min(r[1], sum(r[2])) for r in rows], [r[2] for r in rows]
    most = [sum(h) if p > 0 else lo for p, lo, h in zip(share, least, have)]
    want = max(sum(least), min(size, sum(most)))
    amounts = quota.share_out(want, share, least, most)
    assert abs(sum(amounts) - want) < 1e-6 and all(lo - 1e-9 <= x <= hi + 1e-9 for x, lo, hi in zip(amounts, least, most))
    free = [x / p for x, p, lo, hi in zip(amounts, share, least, most) if lo + 1e-6 < x < hi - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))  # in proportion where no bound holds
    table = [[x * n / sum(h) if sum(h) else 0.0 for n in h] for x, h in zip(amounts, have)]
    got = quota.controlled_rounding(table)
    assert sum(map(sum, got)) == want and all(abs(g - x) < 1 for gr, tr in zip(got, table) for g, x in zip(gr, tr))
    assert all(abs(sum(g) - x) < 1 for g, x in zip(got, amounts)) and all(abs(sum(g[j] for g in got) - sum(t[j] for t in table)) < 1 for j in range(3))
    assert all(lo <= sum(g) for g, lo in zip(got, least))


def test_plans_of_a_size_are_drawn_by_shares(spark):
    rows = [(i, "G" if i % 4 else None, 2020 + i % 3, str(i % 3 + 1), None) for i in range(600)] + [(7, "G", 2021, "2", None)] * 90
    q = spark.createDataFrame(rows, "num long, community string, anio int, categoria string, categoria_nombre string")
    cuotas = [(1, None, 120, 1, "Uno", 0.5, 60, 1), (1, None, 120, 2, "Dos", 0.5, 60, 1), (2, "G", 90, 1, "Uno", 0.9, 81, 1), (2, "G", 90, 3, "Tres", 0.1, 9, 30), (3, None, 10_000, 1, "Uno", 1.0, 10_000, 1), (4, None, 5, 1, "Uno", 0.5, 3, 20), (5, "X", 5, 1, "Uno", 1.0, 5, 1)]
    plans = spark.createDataFrame(cuotas, "plan_id int, comunidad string, tamano int, categoria int, nombre string, proporcion double, n_objetivo int, minimo int")
    got = quota.sample(q, plans).collect()
    counts = {}
    for r in got:
        counts[r["plan_id"], r["categoria"]] = counts.get((r["plan_id"], r["categoria"]), 0) + 1
    assert counts == {(1, 1): 60, (1, 2): 60, (2, 1): 60, (2, 3): 30, (3, 1): 200, (4, 1): 20}
    assert {(r["plan_id"], r["categoria"]): r["tomadas"] for r in quota.shares(q, plans).collect() if r["tomadas"]} == counts
    assert {tuple(r) for r in quota.unmet(q, plans).collect()} == {(3, 1), (5, 1)}


@pytest.mark.parametrize("bits", [14, 1])
def test_samples_fill_every_quota(spark, monkeypatch, bits):
    monkeypatch.setattr(quota, "BUCKET_BITS", bits)
    rows = [(i, ["G", "V"][i % 2], 2020 + i % 3, [" 01", "uno", None, "2", "9"][i % 5], [None, "x", "UNO ", "dos", None][i % 5]) for i in range(400)]
    q = spark.createDataFrame(rows, "num long, community string, anio int, categoria string, categoria_nombre string")
    plans = spark.createDataFrame([(1, None, 1, "Uno", 50, 1), (1, None, 2, "Dos", 5, 100), (2, "G", 1, "Uno", 7, 1), (2, "G", 2, "Dos", 0, 3), (3, "Z", 1, "Uno", 2, 1)], "plan_id int, comunidad string, categoria int, nombre string, n_objetivo int, minimo int")
    got = quota.sample(q, plans).collect()
    counts = {}
    for r in got:
        counts[r["plan_id"], r["categoria"]] = counts.get((r["plan_id"], r["categoria"]), 0) + 1
    assert counts == {(1, 1): 50, (1, 2): 80, (2, 1): 7, (2, 2): 3}
    assert len({(r["plan_id"], r["num"]) for r in got}) == len(got)
    assert {tuple(r) for r in quota.unmet(q, plans).collect()} == {(1, 2), (3, 1)}
    assert sorted(map(tuple, quota.sample(q, plans).collect())) == sorted(map(tuple, got))
    years = {}
    for r in got:
        if (r["plan_id"], r["categoria"]) == (1, 1):
            years[rows[r["num"]][2]] = years.get(rows[r["num"]][2], 0) + 1
    assert max(years.values()) - min(years.values()) <= 2
