import random
import re
from collections import defaultdict

from recollect.llm import templates as T

from .conftest import words

ITEM = "Alice said that Tom bought 12 apples for 3 dollars and then sold 12 pears to Mary for 7 euros near the old station"


def items(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in texts], "item_id long, text string, doc_id string")


def found(docs, bench):
    return {(r.doc_id, r.item_id) for r in T.leaks(docs, bench).collect()}


def test_reparameterised_questions(spark, make):
    docs = make([
        (1, "Well. alice said that Bob bought 15 apples for 9 dollars and then sold 15 pears to Ann for 2 euros near the old station!"),
        (2, "The old station is far away, and they sold twelve pears to nobody at all, for nothing in return."),
        (3, ITEM.upper()), (4, "Foo " * 50 + ITEM.replace(" ", "\n") + " bar" * 50),
    ])
    assert found(docs, items(spark, [(1, ITEM)])) == {(1, 1), (3, 1), (4, 1)}


def test_slots_must_agree(spark, make):
    item = "we have 5 boxes with 5 cups and 8 plates on 5 tables in 8 rooms of 5 houses"
    docs = make([(1, item.replace("5", "6").replace("8", "9")), (2, "we have 1 boxes with 2 cups and 3 plates on 4 tables in 5 rooms of 6 houses")])
    assert found(docs, items(spark, [(7, item)])) == {(1, 7)}


NUMBER = re.compile(r"^(?:[+-]?\d[\d.,:/]*(?:st|nd|rd|th|%)?|[+-]?[$€£]\d[\d.,]*)$")


def template(text):
    """Words and their kinds (0 for plain ones), one after the other."""
    out, opens, before = [], True, 0
    for raw in re.findall(r"[^ \t\n\r\x0b\x0c]+|\n", text or ""):
        if raw == "\n":
            opens = True
            continue
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", raw)
        ends = raw.rstrip("\"')]}»”’").endswith((".", "!", "?", ":", ";"))
        if bare:
            kind = 0
            if bare[0].isdigit() and NUMBER.match(bare):
                kind = 1
            elif bare.lower() in T.UNITS:
                kind = 3 if before == 1 else 0
            elif bare[0].isupper() and bare[1:].islower():
                kind = 0 if opens else 2
            out.append((bare.casefold(), kind))
            before, opens = kind, ends
        else:
            opens = opens or ends
    return out


def shapes(words, n):
    """Windows as they are and as templates: shape, place."""
    for i in range(len(words) - n + 1):
        w = words[i : i + n]
        yield ("plain", *(x for x, _ in w)), i
        slots = sum(k > 0 for _, k in w)
        if slots and n - slots >= T.LITERAL:
            yield ("typed", *((x, 0) if not k else ("", k) for x, k in w)), i


def brute(docs, bench):
    """Every document against every item, by alignments."""
    out = set()
    for item, text in bench:
        there = template(text)
        n = min(T.WINDOW, len(there))
        if not there:
            continue
        where = defaultdict(list)
        for s, i in shapes(there, n):
            where[s].append(i)
        for doc, text_ in docs:
            here = template(text_)
            aligned = defaultdict(set)
            for s, i in shapes(here, n):
                for j in where.get(s, ()):
                    aligned[i - j].add(j)
            covered, verbatim = set(), 0
            for off, places in aligned.items():
                one, two, same = {}, {}, set()
                for j in sorted(places):
                    pairs = [(k, a, b) for (a, k), (b, _) in zip(there[j : j + n], here[j + off : j + off + n]) if k]
                    fits = all(one.get((k, a), b) == b and two.get((k, b), a) == a for k, a, b in pairs) and len({p[:2] for p in pairs}) == len({(k, b) for k, _, b in pairs}) == len({tuple(p) for p in pairs})
                    if fits:
                        for k, a, b in pairs:
                            one[k, a], two[k, b] = b, a
                        covered |= set(range(j, j + n))
                        if all(a == b for _, a, b in pairs):
                            same |= set(range(j, j + n))
                run = 0
                for j in range(len(there) + 1):
                    run = run + 1 if j in same else 0
                    verbatim = max(verbatim, run)
            if covered and (100 * len(covered) >= T.COVER * len(there) or verbatim >= T.VERBATIM):
                out.add((doc, item))
    return out


def test_brute_force(spark, sf):
    """All documents against all items, with templates and slots; and what holds a whole item is found."""
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in T.op3_decontamination(spark, sf).collect()}
    assert got == brute(docs, bench)
    flat = lambda t: " ".join(re.sub(r"[^\w\s]+", "", (t or "").lower()).split())
    assert {(d, i) for d, t in docs for i, s in bench if f" {flat(s)} " in f" {flat(t)} "} <= got


def test_questions_with_other_values(spark, make):
    """Templates filled anew, against the brute force, and all of them are found; those whose slots do not
    agree are not."""
    r = random.Random(4)
    names, units = ["Alice", "Bob", "Mary", "Tom", "Ann", "Zoe"], ["miles", "kg", "dollars", "hours"]
    frames = [
        "a train leaves at {0} and goes {1} {u} before it meets the one that left at {0} from {N} , so how far is it after {1} {u} ?", "when {N} gave {0} coins to {M} the box held {1} coins , and {N} took {0} of them back ; how many were left for {M} then ?",
        "the sum of {0} and {1} is less than {0} times {1} unless one of both is smaller than two , says {N} , and {M} agrees", "what is {0} times {1} ?",
    ]

    def filled(frame, equal=True):
        a, b = r.sample(range(11, 99), 2)
        n, m = r.sample(names, 2)
        text = frame.format(a, b, N=n, M=m, u=r.choice(units))
        return text if equal else re.sub(str(a), lambda _: str(r.randrange(100, 999)), text)

    bench = [(i, filled(f)) for i, f in enumerate(frames)]
    docs = [(10 * i + k, f"{words(i * 9 + k, 20)} and {filled(f)} {words(k, 20)}") for i, f in enumerate(frames) for k in range(6)]
    docs += [(1000 + i, f"some words and {filled(f, False)} more") for i, f in enumerate(frames)] + [(2000, words(3, 200)), (2001, "there is nothing here that asks , or says , anything of the kind at all")]
    got = found(make(docs), items(spark, bench))
    assert got == brute(docs, bench)
    assert {(d, d // 10) for d, _ in docs if d < 1000} <= got and not {d for d, _ in got} & {2000, 2001}


def test_a_verbatim_run_is_enough(spark, make):
    long = words(5, 120, 5000)
    part = lambda n: " ".join(long.split()[40 : 40 + n])
    docs = make([(1, f"before {part(13)} behind"), (2, f"before {part(12)} behind")])
    assert found(docs, items(spark, [(1, long)])) == {(1, 1)}


def test_joined_path_gives_the_same(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = found(docs, bench)
    monkeypatch.setattr(T, "FILTER_ROWS", 0)
    assert found(docs, bench) == want


def test_odd_rows(spark, odd, none):
    bench = items(spark, [(1, ITEM), (2, None), (3, ""), (4, "one two"), (5, "one two"), (None, "!!!")])
    assert found(odd, bench) == {(7, 4), (7, 5), (8, 4), (8, 5)}
    clean = T.clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 2
    assert T.clean(odd, bench.limit(0)).count() == odd.count()
    assert T.leaks(none, bench).count() == 0
