"""The operators on documents: awkward rows, SQL on the small tables, and brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from compare import agree
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import catalogue, components, decontaminate, license_scan, packing, quality_classifier, quality_rules, simhash_dedup
from quillspark.llm.gbt import Boosted
from quillspark.llm.shared import Workspace, table
from quillspark.llm.tokens import ChunkCoder


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql(spark, duck, small, name):
    agree(catalogue.QUERIES[name](spark, small), duck.sql(catalogue.SQL[name]))


# Quality rules


def brute_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_rules_equal_brute_force(spark, docs):
    found = collections.Counter(tuple(r)[:6] for r in quality_rules.quality_rules(spark, docs).collect())
    assert found == collections.Counter((r["doc_id"], *brute_counts(r["text"])) for r in docs.collect())


def test_repeated_words_of_long_texts():
    rng = random.Random(1)
    for n in (0, 4, 5, 30, 400):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(n)] + [bytes([i % 256, i // 256]) for i in range(n)]
        assert quality_rules._repeated_long(words) == quality_rules.repeated_words(words) if len(words) >= 5 else True


def test_host_prior():
    rules = quality_rules.Rules()
    mean, weight = quality_rules.prior_of(200, 100, 50 * 50 / 100 + 50 * 50 / 100, rules)
    assert mean == 0.5 and weight == rules.max_prior
    mean, weight = quality_rules.prior_of(200, 100, 100.0, rules)
    assert weight == 1.0
    assert quality_rules.prior_of(0, 0, 0.0, rules) == (0.0, rules.max_prior)


def test_equal_hosts_have_the_heaviest_prior():
    # 2,000 hosts of five documents, all of rate 0.4: their rates differ by sampling only.
    fails = np.random.default_rng(4).binomial(5, 0.4, 2000)
    mean, weight = quality_rules.prior_of(10_000, int(fails.sum()), float((fails**2 / 5).sum()), quality_rules.Rules(), 2000)
    assert abs(mean - 0.4) < 0.02 and weight > 100
    # Rates drawn from a beta of weight 8.
    fails = np.random.default_rng(4).binomial(50, np.random.default_rng(5).beta(2, 6, 2000))
    assert 6.5 < quality_rules.prior_of(100_000, int(fails.sum()), float((fails**2 / 50).sum()), quality_rules.Rules(), 2000)[1] < 9.5


def test_bad_hosts_go(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, good if i % 20 == 0 else "bad", "spam") for i in range(400)] + [(1000 + i, good, "fine") for i in range(200)] + [(2000 + i, "bad" if i else good, "tiny") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for rules in (quality_rules.Rules(), quality_rules.Rules(broadcast_hosts=0)):
        kept = {r["doc_id"] for r in quality_rules.quality_rules(spark, df, rules).where("kept").collect()}
        assert kept == {1000 + i for i in range(200)} | {2000}
        assert {r["doc_id"] for r in quality_rules.keep_good(spark, df, rules).collect()} == kept


def test_rules_on_nothing(spark, no_docs):
    assert quality_rules.quality_rules(spark, no_docs).count() == 0
    assert quality_rules.keep_good(spark, no_docs).columns == no_docs.columns


# Licences


def test_license_placements(spark, docs):
    r = {x["doc_id"]: x["placements"] for x in license_scan.license_scan(spark, docs).collect()}
    labels = {license_scan.TEMPLATES[p["t"]].label for p in r[8]}
    assert labels == {"cc-by", "cc-by-nc", "reserved", "gpl"} and r[3] == [] and r[9] == []
    assert license_scan.license_scan(spark, docs.limit(0)).count() == 0


def test_license_index_takes_the_rarest_word():
    weights = {w: 0.0 for t in license_scan.TEMPLATES for w in t.words} | {"by": 5.0, "reserved": 2.0}
    postings = license_scan.index(license_scan.TEMPLATES, weights)
    assert (0, 1) in postings["by"] and (2, 2) in postings["reserved"]


def test_partial_templates_need_their_key_phrase(spark):
    df = spark.createDataFrame([(1, "MIT License"), (2, "under the MIT License"), (3, "released under the MIT"), (4, "mit license " * 3)], "doc_id long, text string")
    found = {r["doc_id"]: len(r["placements"]) for r in license_scan.license_scan(spark, df).collect()}
    assert found == {1: 0, 2: 1, 3: 0, 4: 0}


def test_full_licences(spark, duck):
    by_label = {}
    for t in license_scan.TEMPLATES:
        by_label.setdefault(t.label, []).append(t.text)
    texts = {
        "mit": "The MIT License (MIT)\n\nCopyright (c) 2019 Someone\n\n" + "\n\n".join(by_label["mit"][2:]).upper(),
        "bsd-3-clause": "Copyright 1999, Some Institute.\n" + ";\n * ".join(by_label["bsd"]) + " Neither the name of Some Institute of Something " + by_label["bsd-3-clause"][0],
        "changed": by_label["mit"][2].replace("merge publish", "join print").replace("hereby", "hereby"),
        "key lost": by_label["mit"][2].replace("sublicense", "license"),
        "kelvin": "CC BY and \u212a0 \u0130 GENERAL PUBLIC LICENSE " * 3,
    }
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    found = [{license_scan.TEMPLATES[p["t"]].label for p in r["placements"]} for r in license_scan.license_scan(spark, df).orderBy("doc_id").collect()]
    assert found == [{"mit"}, {"bsd", "bsd-3-clause"}, {"mit"}, {"mit"}, {"cc-by", "gpl"}]
    scored = license_scan.license_scan(spark, df).orderBy("doc_id").collect()
    longest = [max(p["score"] for p in r["placements"] if len(license_scan.TEMPLATES[p["t"]].words) > 20) if n < 3 else None for n, r in enumerate(scored)]
    assert longest[0] == 1.0 and 0.9 < longest[2] < 1.0
    assert [r["n_words"] for r in scored][4] == 24


def test_every_notice_is_found_whatever_is_rare(spark):
    df = spark.createDataFrame([(n, f"before {t.text} after") for n, t in enumerate(license_scan.TEMPLATES)], "doc_id long, text string")
    for weights in (None, lambda w: len(w), lambda w: -len(w)):
        words = df.select("doc_id", license_scan.words_of(F.col("text")).alias("w"))
        vocabulary = {t.words[k] for t in license_scan.TEMPLATES for k in t.key_places}
        told = license_scan.idf(words, license_scan.TEMPLATES) if weights is None else {w: float(weights(w)) for w in vocabulary}
        ranks = [license_scan.index(license_scan.TEMPLATES, told, r) for r in range(license_scan.RARE)]
        rows = words.select("doc_id", license_scan.placements(F.col("w"), license_scan.TEMPLATES, ranks).alias("p")).collect()
        assert all((r["doc_id"], 1, 1.0) in [(p["t"], p["start"], p["score"]) for p in r["p"]] for r in rows)


# Decontamination

QUESTION = "Yesterday in the garden old Tom planted 12 trees and 30 kg of seeds before Anna gave him 12 more trees as a present for the spring."


def contaminated(spark, texts, items, settings=decontaminate.Settings()):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(spark, d, b, settings).collect()}


def test_reparameterised_questions(spark):
    other = QUESTION.replace("Tom", "Paul").replace("12", "15").replace("30 kg", "7 pounds").replace("Anna", "Eve")
    broken = QUESTION.replace("12 trees and", "15 trees and")  # one number of the item becomes two
    found = contaminated(spark, ["Some text before. " + QUESTION + " And after.", other, broken, "Nothing of the kind is here, only words about a garden and its many old trees.", None, ""], [QUESTION, "too short", None])
    assert {k for k in found} == {(0, 0), (1, 0)}
    assert found[0, 0]["verbatim"] and not found[1, 0]["verbatim"] and found[0, 0]["first_word"] == 3


def test_short_items(spark):
    found = contaminated(spark, ["we know that water boils at one hundred degrees today", "water boils"], ["water boils at one hundred degrees"])
    assert set(found) == {(0, 0)}


def test_parts_of_long_items(spark):
    item = " ".join(f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "ra", "so", "ti") for b in ("den", "fal", "gor", "hin", "jul", "kam", "lop", "mir"))
    words = item.split()
    found = contaminated(spark, ["before " + " ".join(words[20:33]) + " after", "before " + " ".join(words[20:32]) + " after", " ".join(words[::2])], [item])
    assert set(found) == {(0, 0)}


def test_items_of_few_literal_words(spark):
    items = ["What is 12 + 45 - 7 * 3 / 2 ?", "1981 3.5 17 Rome 2,004 88 Paris 41 12 Oslo 6 1999 Bonn 73", "Who met Anna Berg, Tom Hill, Eva Lund, Max Stein and Ida Holm there?"]
    texts = [f"Some words stand before it. {x} And some behind." for x in items] + ["What is 13 + 46 - 8 * 4 / 3 ?", "They met Paul Berg, Tom Hall and others there, in 1981 and 1999."]
    found = contaminated(spark, texts, items)
    assert set(found) == {(0, 0), (1, 1), (2, 2)} and all(r["verbatim"] for r in found.values())


def test_what_stands_before_an_item(spark):
    item = "What is the capital city of France today?"
    before = ["Geography quiz\n", 'She asked, "', "Well, ", "Question 12 ", "Quiz. "]
    copies = [b + item for b in before] + [item.title(), item.upper(), item.lower(), item.replace(" ", "\n")]
    found = contaminated(spark, copies, [item])
    assert set(found) == {(n, 0) for n in range(len(copies))} and all(r["verbatim"] for r in found.values())
    # With another name it is only a template's match.
    found = contaminated(spark, [b + item.replace("France", "Spain") for b in before], [item])
    assert set(found) == {(n, 0) for n in range(len(before))} and not any(r["verbatim"] for r in found.values())


def test_capital_copies_with_single_letters(spark):
    found = contaminated(spark, ["IT WAS A DAY WITH A BIG STORM", "it was a day with anna berg there"], ["It was a day with a big storm", "It was a day with Anna Berg there"])
    assert set(found) == {(0, 0), (1, 1)}


def test_openings_leave_diagonals_consistent(spark):
    # Only the opening has a template over the first 12; it maps it to 15 and the others map theirs to 16, so it alone doesn't count.
    item = "What 12 old 30 Tom and Anna of 7 small trees were planted near the house by the river with 12 men"
    other = item.replace("What 12", "What 15").replace("with 12", "with 16")
    assert set(contaminated(spark, ["quiz " + other], [item])) == {(0, 0)}


def test_repeated_and_nameless_items(spark):
    short, other = "water boils at one hundred degrees", "ice melts above zero degrees on most warm days in may"
    long = " ".join(f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "ra") for b in ("den", "fal", "gor", "hin", "jul", "kam"))
    d = spark.createDataFrame([(0, f"we know that {short} today"), (1, f"and that {other} too"), (2, "nothing of the kind")], "doc_id long, text string")
    b = spark.createDataFrame([(7, short)] * 5 + [(None, other), (None, other), (None, long), (8, short), (8, long)], "item_id long, text string")
    found = decontaminate.contaminated(spark, d, b).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0, r["cover"]) for r in found) == [(0, 7, 1.0), (0, 8, 1.0), (1, 0, 1.0)]
    assert [r["doc_id"] for r in decontaminate.keep_clean(spark, d, b).collect()] == [2]


def test_rows_that_share_an_id_with_a_copy(spark):
    rows = [(1, f"first {QUESTION}"), (1, "a clean text under the same id"), (None, f"then {QUESTION}"), (None, "a clean one without any id")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, QUESTION)], "item_id long, text string")
    for limit in (1_000_000, 0):
        assert sorted(r["text"][:7] for r in decontaminate.keep_clean(spark, d, b, broadcast_docs=limit).collect()) == ["a clean", "a clean"]


def test_very_short_items(spark):
    assert set(contaminated(spark, ["Paris it is", "paris it is!", "They say Paris it is, or so."], ["Paris it is"])) == {(0, 0), (1, 0)}


def test_windows_that_many_items_share(spark):
    said = "Read the question below with care, then choose the only right answer among those that are given to you here."
    items = [f"{said} {q}" for q in ("".join(f"{a}{n} " for a in ("walk", "stone", "river", "tall", "green", "under", "seven", "light", "house", "cold")) for n in "abcdefghijklmnopqrst")]
    found = contaminated(spark, [f"before {said} after", f"before {items[3]} after", f"before {items[3][len(said) :]} after"], items)
    assert set(found) == {(1, 3), (2, 3)}
    assert set(contaminated(spark, [f"before {said} after"], [f"{said} {n}" for n in range(20)])) == {(0, n) for n in range(20)}


def reparameterised(rng, template):
    """A template with its <n>, <w>, <name>, <unit> and <unit2> filled in anew."""
    pools = {"n": [str(int(x)) for x in rng.integers(2, 900, 8)], "w": list(rng.permutation(["two", "three", "ninety", "twelve", "twenty-five", "six"])), "name": list(rng.permutation(["Tom", "Anna", "Berlin", "Oslo", "Eve", "Paul"])), "unit": list(rng.permutation(["kilometers", "miles", "meters", "feet", "kilograms", "hours"]))}
    return re.sub("<(n|w|name|unit)>", lambda m: str(pools[m[1]].pop()), template)


QUESTIONS = [
    "A train travels <n> <unit> in <n> hours before it stops, so what is its average speed in <unit> per hour over the whole way?",
    "If <name> buys <n> apples and <n> pears at the market and gives <n> of them to <name>, how many pieces of fruit are left over?",
    "The tank holds <n> <unit> of water and loses <w> of them every day, so after how many days will the tank be empty?",
    "In the village of <name> there are <n> houses with <w> windows each, how many windows must the glazier clean every year?",
    "Yesterday <name> walked <n> <unit> from the mill to the bridge while <name> took the longer way around the hill with the dog.",
    "A farmer sells <w> sacks of grain for <n> dollars each and spends <n> dollars on seeds, what does he keep in the end?",
    "When the clock struck <w> the guests from <name> had been waiting for <n> minutes, how long did they wait after the meal?",
    "<name> reads <n> pages of a book every day, and the book has <n> pages, so how many weeks does it take to read it?",
]


def test_recall_of_reparameterised_questions(spark):
    rng = np.random.default_rng(8)
    items = [reparameterised(rng, q) for q in QUESTIONS]
    places = ["", "Some words before it. ", "Quiz\n", "and so: ", "Question 12 "]
    copies = [(n, places[k] + reparameterised(rng, q) + " And words behind.") for n, q in enumerate(QUESTIONS) for k in range(5)]
    clean = ["The train stops in the village where a farmer sells apples, pears and grain for some dollars every day.", "Tom walked 30 miles in 4 hours while Anna read 20 pages of a book about the clock in Oslo."]
    found = contaminated(spark, [c for _, c in copies] + clean, items)
    caught = sum((k, n) in found for k, (n, _) in enumerate(copies))
    assert caught >= 0.9 * len(copies), caught
    assert {k for k in found} <= {(k, n) for k, (n, _) in enumerate(copies)}


def test_values_that_become_equal(spark):
    item = "A train travels 90 kilometers in 3 hours before it stops, so what is its speed in kilometers per hour?"
    texts = [item.replace("90", "12").replace("3 hours", "12 hours"), item.replace("90", "ninety").replace("3", "three"), item.replace("kilometers", "miles"), item.replace("in kilometers", "in miles")]
    found = contaminated(spark, texts, [item])
    assert {(0, 0), (1, 0), (2, 0)} <= set(found)


def test_bloom_grows_with_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "LEAST_BLOOM", 1 << 12)
    windows = spark.range(40_000).select(F.xxhash64("id").alias("hash"))
    mask = decontaminate.bloom(windows)
    h = np.array([r["hash"] for r in windows.collect()], np.int64).view(np.uint64)
    place, want = decontaminate._bits(h, len(mask))
    other = np.random.default_rng(0).integers(0, 1 << 63, 100_000, np.uint64)
    at, bits = decontaminate._bits(other, len(mask))
    assert len(mask) == 1 << 14 and (mask[place] & want == want).all() and (mask[at] & bits == bits).mean() < 0.05


def test_templates_count_apart(spark):
    # Two of the item's 12 windows have a template, and a copy with other numbers can meet no others.
    item = "11 12 13 14 15 16 17 18 19 20 21 22 23 24 boil the old water then"
    other = " ".join(str(int(w) + 50) if w.isdigit() else w for w in item.split())
    r = contaminated(spark, [other], [item])[0, 0]
    assert r["cover"] == 1 and r["windows"] < 4 and not r["verbatim"]


def test_decontamination_equals_brute_force(spark, small):
    docs, items = table(spark, small, "documents"), table(spark, small, "benchmark")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark, docs, items).collect()}
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    expected = set()
    for item in items.collect():
        w = words(item["text"])
        windows = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for d in docs.collect():
            v = words(d["text"])
            met = len(windows & {tuple(v[i : i + 8]) for i in range(len(v) - 7)})
            if met and (met >= 0.3 * len(windows) or met >= 6):
                expected.add((d["doc_id"], item["item_id"]))
    assert found == expected


def test_clean_documents_stay(spark, docs, no_docs):
    items = spark.createDataFrame([(0, "the quick brown fox jumps over the lazy dog while a small bird sings")], "item_id long, text string")
    kept = decontaminate.keep_clean(spark, docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [3, 4, 5, 6, 7, 8, 9]
    assert sorted(r["doc_id"] or 0 for r in decontaminate.keep_clean(spark, docs, items, broadcast_docs=0).collect()) == [3, 4, 5, 6, 7, 8, 9]
    assert decontaminate.keep_clean(spark, no_docs, items).count() == 0
    assert decontaminate.keep_clean(spark, docs, items.limit(0)).count() == docs.count()


# SimHash


def brute_fingerprint(t):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(fps)):
        groups[find(i)].append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_fingerprints_and_components(spark, docs):
    rows = docs.collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    expected = collections.Counter(zip([r["doc_id"] for r in rows], fps, brute_components(fps, [r["doc_id"] for r in rows])))
    found = simhash_dedup.simhash_components(spark, docs).collect()
    assert collections.Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == expected
    kept = simhash_dedup.keep_first(spark, docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(i or 0 for i in ids) == sorted({r["component_id"] or 0 for r in found})


def brute_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (brute_words(a), brute_words(b)))
    return len(x & y) / len(x | y)


def brute_copies(found, ids):
    """Of each text the smallest id of its group: what links of at most 2 bits connect, with verified pairs only."""
    fps = [[f % (1 << 64) for f in simhash_dedup.word_fingerprints([w.encode() for w in brute_words(t)], 6)] for t in found]
    linked = list(range(len(found)))
    for a in range(len(found)):
        for b in range(a):
            if linked[a] != linked[b] and any((x ^ y).bit_count() <= 2 for x, y in zip(fps[a], fps[b])):
                linked = [linked[b] if c == linked[a] else c for c in linked]
    groups = collections.defaultdict(list)
    for n, c in enumerate(linked):
        groups[c].append(n)
    root = list(range(len(found)))
    for members in groups.values():
        for k, a in enumerate(members):
            for b in members[:k]:
                if root[a] != root[b] and similarity(found[a], found[b]) >= 0.8:
                    root = [root[b] if r == root[a] else r for r in root]
    return [min((ids[m] for m in range(len(ids)) if root[m] == root[n]), key=lambda i: (i is None, i or 0)) for n in range(len(ids))]


def test_near_copies_equal_brute_force(spark, docs):
    rows = docs.collect()
    first = brute_copies([r["text"] for r in rows], [r["doc_id"] for r in rows])
    kept = simhash_dedup.keep_distinct(spark, docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter({i for i in first})


@pytest.mark.parametrize("broadcast", [1_000_000, 3])
def test_planted_near_copies(spark, broadcast):
    # 100 groups of a text and two copies with a changed word in 40 to 150, and shuffled words, which aren't copies.
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows = []
    for group in range(100):
        base = [rng.choice(words) for _ in range(rng.randint(100, 400))]
        rows.append((3 * group, " ".join(base)))
        for k in (1, 2):
            copy = list(base)
            for _ in range(max(1, len(copy) // rng.randint(80, 150))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((3 * group + k, "\n".join(copy).upper()))
        rows.append((1000 + group, " ".join(sorted(base))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash_dedup.keep_distinct(spark, df, broadcast_docs=broadcast).collect()}
    assert {i for i, _ in rows if i >= 1000 or i % 3 == 0} <= kept
    assert len([i for i in range(300) if i % 3 and i not in kept]) >= 0.9 * 200


def test_word_fingerprints():
    from xxhash import xxh64_intdigest

    words = [f"w{i}".encode() for i in range(101)]
    hashes = [xxh64_intdigest(w, 42) for w in words]
    first, *others = simhash_dedup.word_fingerprints(words * 2, 3)
    assert first % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 101)
    assert all(16 <= ((x ^ y) % (1 << 64)).bit_count() <= 48 for x, y in [(first, others[0]), (first, others[1]), tuple(others)])
    assert simhash_dedup.word_fingerprints([], 3) == [0, 0, 0]


def test_near_copies_on_awkward_rows(spark, no_docs):
    assert simhash_dedup.keep_distinct(spark, no_docs).count() == 0
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(1, "a b c", "x"), (1, "A  b c", "y"), (1, "a b c", "x"), (None, None, "x"), (7, "", None), (None, "d e f g h i j", "x"), (3, long, "x"), (2, long + " end", "x")]
    kept = simhash_dedup.keep_distinct(spark, spark.createDataFrame(rows, "doc_id long, text string, id_a string"))
    assert kept.columns == ["doc_id", "text", "id_a"]
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept.collect() if r["doc_id"] != 1) == [(0, 13), (2, len(long) + 4), (7, 0)]
    assert kept.where("doc_id = 1").count() == 1


def test_rows_that_share_an_id(spark):
    a, b = ("the first of two texts that have nothing at all in common with each other " * 2, "another one which says something else entirely about its own quite different matter " * 2)
    kept = lambda rows: sorted((r["doc_id"] or 0, r["text"][:3]) for r in simhash_dedup.keep_first(spark, spark.createDataFrame(rows, "doc_id long, text string, id_a string")).collect())
    assert kept([(1, a, "x"), (2, a, "x"), (2, b, "x")]) == [(1, "the"), (2, "ano")]
    assert kept([(2, a, "x"), (2, b, "x")]) == [(2, "ano"), (2, "the")]
    assert kept([(3, a, "x")] * 50 + [(None, a, "y")] * 50 + [(None, b, "y")] * 50) == [(0, "ano"), (3, "the")]


def test_a_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from quillspark.llm.shared import shared_dir

    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(cluster)


def test_long_texts_are_counted_in_blocks(monkeypatch):
    raw = " ".join(f"w{i}" for i in range(1000)).encode()
    whole = simhash_dedup.fingerprint(raw)
    monkeypatch.setattr(simhash_dedup, "BLOCK", 64)
    assert simhash_dedup.fingerprint(raw) == whole


@pytest.mark.parametrize("digests,chunk", [(1000, 16), (simhash_dedup.BUCKET_DIGESTS, simhash_dedup.CHUNK)])
def test_links_equal_brute_force(spark, digests, chunk):
    rng = random.Random(7)
    fps = {0, (1 << 64) - 1}
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [simhash_dedup._signed(x) for x in fps]
    ws = Workspace(spark, "test")
    reached = {r["node"]: r["root"] for r in components.components(ws, simhash_dedup.links(ws, spark.createDataFrame([(x,) for x in signed], "fp long"), digests, chunk)).collect()}
    assert [reached.get(x, x) for x in signed] == brute_components(fps, signed)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)]
    found = {r["node"]: r["root"] for r in components.components(Workspace(spark, "chain"), spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_simhash_on_nothing(spark, no_docs):
    assert simhash_dedup.simhash_components(spark, no_docs).count() == 0
    assert simhash_dedup.keep_first(spark, no_docs).count() == 0


# Packing


def test_ids_equal_the_tokenizer(docs):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    texts = [r["text"] or "" for r in docs.collect()] + ["It's 3 o'clock\u00a0now\r\nLIGNE deux", "  a  b ", "e\u0301te\u0301 \u0301x"]
    whole = [t.ids for t in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for limit in (300_000, 0):
        coder = ChunkCoder(path, limit)
        assert [x.tolist() for x in coder.encode(texts)] == whole
        assert [x.tolist() for x in coder.encode(texts[::-1])] == whole[::-1]


def test_ids_equal_other_tokenizers(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [r["text"] or "" for r in docs.collect()] + [" Two  Words\n", "It's"]
    coder = ChunkCoder(path)
    assert not coder.chunked and ChunkCoder(packing.tokenizer_path()).chunked
    assert [x.tolist() for x in coder.encode(texts)] == [t.ids for t in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_packing(spark, docs, no_docs):
    rows = packing.pack_documents(spark, docs, task_pieces=5).collect()
    coder = ChunkCoder(packing.tokenizer_path())
    expected = collections.Counter()
    for r in docs.collect():
        ids = np.append(coder.encode([r["text"] or ""])[0], 1).astype("<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            expected[r["doc_id"], k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in rows) == expected
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 4096
    assert packing.pack_documents(spark, no_docs).count() == 0


def test_best_fit_and_local_search():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 3000):
        sizes = rng.integers(1, 900, n)
        bins = packing.pack(sizes, 1000)
        assert sorted(r for b in bins for r in b) == list(range(n)) and all(sizes[b].sum() <= 1000 for b in bins)
        assert len(bins) <= 1.02 * sizes.sum() / 1000 + 12


def test_one_document_id_for_all(spark):
    # A hot id, and pieces of over half a sequence that no other fits: all are tried, none is lost.
    df = spark.createDataFrame([(None if n % 2 else 7, "word " * (2100 if n % 3 == 0 else 1 + n)) for n in range(90)], "doc_id long, text string")
    rows = packing.pack_documents(spark, df, task_pieces=20).collect()
    fills = collections.Counter()
    for r in rows:
        fills[r["sequence_id"]] += r["length"]
    lengths = sorted((r["length"] for r in rows))
    assert len(rows) == 90 and max(fills.values()) <= 4096 and lengths.count(2101) == 30
    assert len(fills) <= 31


def test_search_ends_without_patience():
    rng = np.random.default_rng(5)
    for sizes in (rng.integers(900, 1300, 800), np.concatenate([np.full(300, 2100), rng.integers(1, 1500, 300)]), rng.integers(2049, 4096, 300)):
        bins = packing.pack(sizes, 4096)
        assert sorted(r for b in bins for r in b) == list(range(len(sizes))) and len(bins) <= len(packing.best_fit(sizes, 4096))
        search = packing.LocalSearch(bins, sizes, 4096)
        assert len(bins) == search.least or not any(search._step(v) for v in np.flatnonzero(search.fill < 4096))


def test_exchanges():
    # Nothing fits a gap as it is; one for one makes room for a move that empties the last bin.
    search = packing.LocalSearch([[0, 1, 2], [3, 4, 5], [6]], np.array([6, 2, 1, 5, 3, 1, 2]), 10)
    squares = (search.fill**2).sum()
    assert len(search.run()) == 2 and (search.fill**2).sum() > squares
    # Two for one: 3 + 2 against 4.
    search = packing.LocalSearch([[0, 1], [2, 3, 4], [5, 6]], np.array([4, 5, 6, 2, 1, 3, 2]), 10)
    before = (search.fill**2).sum()
    search._step(2)
    assert (search.fill**2).sum() > before
    # A local optimum stays, complete.
    assert sorted(sum(packing.LocalSearch([[0], [1]], np.array([6, 6]), 10).run(), [])) == [0, 1]


# Quality classifier


def test_gbt_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = Boosted().fit(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert Boosted().fit(x[:0], y[:0]).predict(x[:2]).tolist() == [0.5, 0.5]


def test_co_training_uses_the_pool():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000).astype(float)
    text = y[:, None] * 3 + rng.normal(size=(4000, 2))
    meta = y[:, None] * 1.5 + rng.normal(size=(4000, 2))
    few = slice(0, 100)
    model = quality_classifier.co_train([text[few], meta[few]], y[few], quality_classifier.in_memory([text[100:2000], meta[100:2000]], quality_classifier.Settings()))
    assert ((model.score(text[2000:], meta[2000:]) > 0.5) == y[2000:]).mean() > 0.93


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    train, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    scored = quality_classifier.score_documents(docs, quality_classifier.train(docs, train))
    assert scored.count() == docs.count()
    right = scored.join(held, "doc_id").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.95


def test_classifier_on_awkward_rows(spark, docs, no_docs):
    for labels in ([], [(1, 1), (5, 0), (77, 0), (None, 1), (2, None)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int")
        model = quality_classifier.train(docs, known)
        scored = quality_classifier.score_documents(docs, model)
        assert scored.count() == docs.count() and scored.where("score IS NULL OR score < 0 OR score > 1").isEmpty()
        kept = quality_classifier.keep_good(spark, docs, known)
        assert kept.columns == docs.columns and kept.count() == scored.where("kept").count()
        assert quality_classifier.keep_good(spark, no_docs, known).count() == 0


def test_one_labelled_id_of_many_rows(spark, monkeypatch):
    df = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    seen = []
    monkeypatch.setattr(quality_classifier, "co_train", lambda x, y, pick, settings: seen.append(y) or quality_classifier.CoTrained(0.5, [(quality_classifier.Constant(0.5), 1.0, 0.0)] * 2))
    quality_classifier.train(df, spark.createDataFrame([(7, 1)] * 40, "doc_id long, quality int"))
    assert len(seen[0]) == 1


def test_pseudo_labels_come_from_every_stratum(spark):
    rng = np.random.default_rng(2)
    rows = [(n, [float(v) for v in rng.normal(size=quality_classifier.TEXT_FEATURES) + 4 * (n % 2)], "en", "hot" if n % 3 else f"s{n % 7}", 5) for n in range(4000)]
    features = spark.createDataFrame([*rows, *rows[:1] * 500], "doc_id long, x array<double>, lang string, source string, size long")
    x = np.array([r[1] for r in rows])
    settings = quality_classifier.Settings(taught=80)
    models = [quality_classifier.Logistic().fit(x, np.array([n % 2 for n in range(4000)], float)), quality_classifier.Constant(0.5)]
    (views, label), (none, _) = quality_classifier._from_all(features, settings)(models, 0)
    strata = collections.Counter(quality_classifier._strata(views[1]).tolist())
    assert len(none[0]) == 0 and len(strata) == 8 and 100 < len(label) < 240 and 0.3 < label.mean() < 0.7
    assert max(strata.values()) < 60


# The pipeline


def test_pipeline(spark, small):
    docs = table(spark, small, "documents")
    good = quality_classifier.keep_good(spark, docs, table(spark, small, "labels")).collect()
    failed = {r["doc_id"] for r in good if (c := brute_counts(r["text"]))[0] < 10 or 100 * c[4] > 20 * c[0]}
    left = [r for r in good if r["doc_id"] not in failed and 100 * brute_counts(r["text"])[2] <= 20 * brute_counts(r["text"])[0]]
    first = brute_copies([r["text"] for r in left], [r["doc_id"] for r in left])
    single = [r["doc_id"] for r, c in zip(left, first) if r["doc_id"] == c]
    leaks = {r["doc_id"] for r in decontaminate.contaminated(spark, docs, table(spark, small, "benchmark")).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, small).collect()} == set(single) - leaks
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_keeps_columns(spark, docs, small):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_pipeline_on_awkward_rows(spark, docs, small, tmp_path):
    # Nulls, empty and long texts, repeated rows and ids, and columns that clash with the stages' own names.
    good = table(spark, small, "documents").where("n_chars BETWEEN 300 AND 3000").limit(30)
    for c in docs.columns[5:]:
        good = good.withColumn(c, F.lit(None).cast(docs.schema[c].dataType))
    rows = docs.unionByName(good).unionByName(good.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(good.limit(3))
    for name, df in (("documents", rows), ("labels", table(spark, small, "labels")), ("benchmark", table(spark, small, "benchmark"))):
        df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    found = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    ids = [r["doc_id"] for r in found if r["piece"] == 0]
    # Copies under a null id go with the named one that they copy; the fixture's own text without an id copies none.
    assert ids and ids.count(None) <= 1 and len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in rows.select("doc_id").collect()}
    empty = tmp_path / "empty"
    for name, df in (("documents", rows.limit(0)), ("labels", table(spark, small, "labels")), ("benchmark", table(spark, small, "benchmark").limit(0))):
        df.write.parquet(f"file://{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{empty}").count() == 0
