import random

import pytest

from seriesloom.llm.linededup import dedup_lines


def brute(rows):
    """rows: (id, text) in order; returns kept texts."""
    places, out = [], []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] is not None, rows[i][1] or ""))
    for i in order:
        d, text = rows[i]
        if d is None or text is None:
            out.append((d, text, len(text.split("\n")) if text is not None else 0, 0))
            continue
        kept = []
        all_lines = text.split("\n")
        for line in all_lines:
            s = frozenset(w for w in line.translate({c: " " for c in range(9, 14)}).split(" ") if w)
            if not s or not any(9 * len(s & p) >= 4 * (len(s) + len(p)) for p in places):
                kept.append(line)
            if s:
                places.append(s)
        out.append((d, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(df).collect()), key=str)


def test_random_variants_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(words) for _ in range(n)] for n in (1, 2, 3, 5, 8, 10, 12, 20, 40, 70, 90, 150)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, 1 + len(line) // 8)):
                line[rng.randrange(len(line))] = rng.choice([*words, f"u{rng.random()}"])
            lines.append(" ".join(line))
        rows.append((d - 30, "\n".join(lines)))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


ODD = [(1, None), (2, ""), (3, "\n\n"), (4, "a b c\na b c\n\nx"), (4, "c b a"), (4, None), (None, "a b c"), (5, "a\tb  c"), (6, "x " * 50000), (7, "é É"), (8, "é É\ny y y")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(d, t, 9, "n") for d, t in ODD], "doc_id long, text string, n_lines int, line string")
    found = dedup_lines(df)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found.collect()), key=str) == brute(ODD)
    assert "line" in found.columns


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_no_lines(spark, rows):
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_one_text_of_very_many_lines(spark):
    import time

    lines = [f"w{i % 20000} x{i % 20000} y{i % 20000} common words here" for i in range(60_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:10]))], "doc_id long, text string")
    begun = time.perf_counter()
    found = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert (found[1].n_lines, found[1].n_removed, found[2].n_removed) == (60_000, 40_000, 10)
    assert found[1].text == "\n".join(lines[:20_000]) and found[2].text == ""
    assert time.perf_counter() - begun < 120


def test_near_copies_in_a_large_group_against_brute_force(spark):
    """Copies of one line with one or two words changed, short and long."""
    rng = random.Random(11)
    rows, at = [], 0
    for n in (5, 9, 12, 20, 44):
        base = [f"b{n}_{i}" for i in range(n)]
        for _ in range(25):
            line = list(base)
            for k in rng.sample(range(n), rng.randint(0, 2)):
                line[k] = f"u{rng.random()}"
            rows.append((at, " ".join(line)))
            at += 1
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_copies_with_a_rare_sentence_of_their_own_meet_their_leaders(spark, monkeypatch):
    """What copies do not share is rarer than what they share; pairs by the square
    would be 7,140."""
    from seriesloom.llm import linededup

    base = " ".join(f"b{i}" for i in range(50))
    rows = [(i, " ".join(f"own{i}_{k}" for k in range(5)) + f" {base}") for i in range(120)]
    rows.append((500, " ".join(f"noise{i} noise{i}" for i in range(300)) + " the" * 4000))
    made = {}

    def counted(df, label, **options):
        made[label] = kept(df, label, **options)
        made[label + " rows"] = made[label].count()
        return made[label]

    kept = linededup.stored
    monkeypatch.setattr(linededup, "stored", counted)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert made["met rows"] < 500


def test_copies_with_words_left_out_across_octaves_of_lengths(spark):
    """The longer line of a pair has one of 2, 4, 8, ... words or a few more, the shorter fewer."""
    rng = random.Random(3)
    rows, at = [], 0
    for n in (2, 4, 5, 8, 10, 16, 19, 32, 40, 64, 75, 128, 150):
        for k in range(12):
            base = [f"b{n}_{k}_{i}" for i in range(n)]
            both = [base, rng.sample(base, -(-4 * n // 5) - (k % 3 == 2))]
            for line in both if k % 2 else reversed(both):
                rows.append((at, " ".join(line)))
                at += 1
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_the_line_of_fewer_words_is_found_by_fewer_posted_words(spark, monkeypatch):
    """Lines of 20 words that share 17 are too far apart, but not all by their parities."""
    from seriesloom.llm import linededup

    rows = [(2 * g + h, " ".join([f"c{g}_{i}" for i in range(17)] + [f"o{g}_{h}_{i}" for i in range(3)])) for g in range(400) for h in (0, 1)]
    made = {}

    def counted(df, label, **options):
        made[label] = kept(df, label, **options)
        made[label + " rows"] = made[label].count()
        return made[label]

    kept = linededup.stored
    monkeypatch.setattr(linededup, "stored", counted)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert made["met rows"] < 30


def test_leader_keys_that_one_line_alone_has_are_left_out(spark, monkeypatch):
    """Of 300 lines without a common word only the last three have keys in common."""
    from seriesloom.llm import linededup

    rows = [(i, " ".join(f"w{i}_{k}" for k in range(12))) for i in range(300)]
    rows += [(300, rows[0][1] + " more"), (301, rows[0][1] + " other"), (302, rows[0][1])]
    made = {}

    def counted(df, label, **options):
        made[label] = kept(df, label, **options)
        made[label + " rows"] = made[label].count()
        return made[label]

    kept = linededup.stored
    monkeypatch.setattr(linededup, "stored", counted)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert made["keys rows"] <= 4 * 3


def test_subsets_of_lines_of_every_length(spark):
    rng = random.Random(7)
    rows = []
    for n in range(2, 100):
        base = [f"b{n}_{i}" for i in range(n)]
        both = [base, rng.sample(base, -(-4 * n // 5) - (n % 3 == 2))]
        rows += [(2 * n + k, " ".join(line)) for k, line in enumerate(both if n % 2 else reversed(both))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_gaps_of_all_kinds(spark):
    texts = ["a b c d e", " a b c d e", "a b c d e ", "a\tb\x0bc\x0cd\re", "\ta  b c\t\td e\r", " ", "\t", "\x0b\x0c\r", "\r\n\r\n", "e d c b a\r\nf", "f\r"]
    rows = list(enumerate(texts))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
