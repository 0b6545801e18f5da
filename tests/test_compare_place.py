import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quire.operators import compare, place


def match(a, b, threshold):
    if a in b or b in a:
        return min(len(a), len(b)) / max(len(a), len(b))
    ratio = SequenceMatcher(None, a, b).ratio()
    return ratio if ratio >= threshold else None


def test_pairs_against_plain_rule(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcd ") for _ in range(r.randint(3, 30))) for _ in range(12)]
    a = [(p, i, q) for p in (1, 2) for i, q in enumerate(base[p : p + 6])]
    b = [(p, i, q[r.randint(0, 3) :] + r.choice(["", "zz"])) for p in (2, 1) for i, q in enumerate(base[p : p + 7])] + [(3, 0, "only here")]
    schema = "page int, ix long, quote string"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    pairs = compare.pair_candidates(left, right, 0.8)
    expected = {(p, i, j): s for p, i, x in a for p2, j, y in b if p == p2 and (s := match(x, y, 0.8)) is not None}
    assert {(x["page"], x["i"], x["j"]): round(x["score"], 9) for x in pairs.collect()} == {k: round(s, 9) for k, s in expected.items()}
    taken, used = set(), set()
    for (p, i, j), _ in sorted(expected.items(), key=lambda x: (-x[1], x[0][1], x[0][2])):
        if (p, "a", i) not in used and (p, "b", j) not in used:
            used |= {(p, "a", i), (p, "b", j)}
            taken.add((p, i, j))
    chosen = compare.greedy_pairing(pairs)
    assert {(x["page"], x["i"], x["j"]) for x in chosen.collect()} == taken
    pages = {x["page"]: x for x in compare.compare_pages(left, right, chosen).collect()}
    assert pages[3]["status"] == "NO_MATCH" and pages[3]["similarity"] == 0
    total = compare.overall_similarity(compare.compare_pages(left, right, chosen)).first()
    assert total["similarity"] == round(200 * len(taken) / (len(a) + len(b)), 6)


def read_words(needle, words):
    """The first run of words that reads as needle, hyphens at word ends joined."""
    for start in range(len(words) - len(needle) + 1):
        at = start
        for token in needle:
            if at < len(words) and words[at] == token:
                at += 1
            elif at + 1 < len(words) and words[at].endswith("-") and words[at][:-1] + words[at + 1] == token:
                at += 2
            else:
                at = -1
                break
        if at > start:
            return start, at
    return None


def test_word_sequences(spark):
    r = random.Random(5)
    cases = []
    for _ in range(60):
        words = [r.choice(["a", "b", "so-", "me", "some", "thing"]) for _ in range(r.randint(1, 8))]
        needle = [r.choice(["a", "b", "some", "so-", "me"]) for _ in range(r.randint(1, 3))]
        cases.append((needle, words))
    df = spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(cases)], "i int, needle array<string>, words array<string>")
    got = {x["i"]: x["r"] and tuple(x["r"]) for x in df.select("i", place.word_sequence_match(F.col("needle"), F.col("words")).alias("r")).collect()}
    assert got == {i: read_words(n, ws) for i, (n, ws) in enumerate(cases)}


def merged(rects):
    out = []
    for x0, y0, x1, y1 in sorted(rects, key=lambda r: ((r[1] + r[3]) / 2, r[0])):
        if out and abs((y0 + y1) / 2 - (out[-1][1] + out[-1][3]) / 2) <= 2 and x0 <= out[-1][2] + 3:
            a = out[-1]
            out[-1] = (min(a[0], x0), min(a[1], y0), max(a[2], x1), max(a[3], y1))
        else:
            out.append((x0, y0, x1, y1))
    return out


def test_merged_rects(spark):
    r = random.Random(6)
    cases = [[(x := float(r.randint(0, 60)), y := float(r.randint(0, 8)), x + r.randint(1, 20), y + r.randint(4, 8)) for _ in range(r.randint(1, 7))] for _ in range(40)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, r array<struct<x0:double,y0:double,x1:double,y1:double>>")
    got = {x["i"]: [tuple(m) for m in x["m"]] for x in df.select("i", place.merge_line_rects(F.col("r")).alias("m")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == merged(c)


def placed(notes, page_height):
    """Tops in order: pushed below what is hit, else above, else left where it ends."""
    done = []
    for y, height in notes:
        low, high = 4.0, page_height - 4
        height = min(height, high - low)
        clamp = lambda v: min(max(v, low), max(low, high - height))  # noqa: B023, E731
        free = False
        for move in (lambda o: o[1] + 3, lambda o: o[0] - height - 3):  # noqa: B023
            top = clamp(y)
            for _ in range(24):
                hit = next((o for o in done if top + height + 2 > o[0] and o[1] + 2 > top), None)
                if hit is None:
                    free = True
                    break
                top = clamp(move(hit))
            if free:
                break
        done.append((top, top + height))
    return [round(t, 6) for t, _ in done]


def test_notes_are_stacked(spark):
    r = random.Random(7)
    cases = [[(float(r.randint(0, 200)), float(r.randint(20, 80))) for _ in range(r.randint(1, 6))] for _ in range(25)]
    rows = [("b", i, k, 500.0, 600.0, y, h, 260.0) for i, c in enumerate(cases) for k, (y, h) in enumerate(c)]
    out = place.place_notes(spark.createDataFrame(rows, "book string, page int, seq long, x0 double, x1 double, y double, height double, page_height double")).collect()
    for i, c in enumerate(cases):
        assert [round(x["top"], 6) for x in sorted((x for x in out if x["page"] == i), key=lambda x: x["seq"])] == placed(c, 260.0)


def test_margins_and_notes(spark):
    words = spark.createDataFrame([("a", 1, 100.0, 110.0, 400.0), ("a", 1, 5.0, 15.0, 600.0), ("a", 2, 100.0, 110.0, 580.0)], "book string, page int, y0 double, y1 double, x1 double")
    sizes = spark.createDataFrame([("a", p, 612.0, 792.0) for p in (1, 2, 3)], "book string, page int, width double, height double")
    edge = place.body_right_edge(words, sizes)
    got = {r["page"]: (r["free_margin"], r["b"]["x0"]) for r in edge.select("page", "free_margin", place.margin_band(F.col("free_margin"), F.col("width")).alias("b")).collect()}
    assert got == {1: (198.0, 486.0), 2: (18.0, 534.0), 3: (598.0, 486.0)}
    height = lambda s, w: spark.range(1).select(place.estimate_note_height(F.lit(s), F.lit(w), F.lit(8.0)).alias("h")).first()["h"]
    assert height("a b", 72.0) == 20 and height("word " * 30, 72.0) > 100
    size = lambda s: spark.range(1).select(place.note_fontsize(F.lit(s), F.lit(72.0), F.lit(300.0)).alias("h")).first()["h"]
    assert size("short") == 8.0 and size("word " * 200) == 6.0


def test_quotes_are_found(spark):
    pages = spark.createDataFrame([("a", 1, "one two"), ("a", 2, "the some- thing here"), ("a", 3, "last words")], "book string, page long, text string")
    words = pages.select("book", "page", F.posexplode(F.split("text", " ")).alias("word_ix", "word")).select("book", "page", F.col("word_ix").cast("long").alias("word_ix"), *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")], "word")
    books = spark.createDataFrame([("a", 3)], "book string, total_pages long")
    targets = spark.createDataFrame([(1, "a", 1, "one  two"), (2, "a", 2, "something here"), (3, "a", 2, "last words"), (4, "a", 9, "x"), (5, "a", 1, "last words")], "target_id int, book string, page long, quote string")
    got = {r["target_id"]: (r["found_page"], r["method"], r["reason"]) for r in place.find_quotes(targets, pages, words, books).collect()}
    assert got == {1: (1, "search_for", None), 2: (2, "word_sequence", None), 3: (3, "search_for_neighbor_p3", None), 4: (None, None, "page_out_of_range"), 5: (None, None, "quote_not_found")}
