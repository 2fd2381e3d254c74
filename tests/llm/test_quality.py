import collections
import random
import re

from assayer.llm import quality

from .fixtures import DOCS, LABELS, docs, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "é\n", "# ", "x y z \n", "  ", "\x1c", "a b c d e f g h "]) for _ in range(rng.randint(0, 40)))
        assert quality.counts(text.encode())[:5] == plain(text)


def test_bounds():
    # published Clopper-Pearson values, one-sided 95 %: 3/n for none seen, and 5 of 100
    assert abs(quality.upper_bound(0, 100, 0.05) - 0.029513) < 1e-5
    assert abs(quality.upper_bound(5, 100, 0.05) - 0.102253) < 1e-4
    assert quality.upper_bound(10, 10, 0.05) == 1.0
    assert abs(quality.binomial_cdf(2, 10, 0.3) - 0.3827827864) < 1e-9


def test_certified_stops_at_the_first_failure():
    assert quality.certified([0, 0, 500, 0], [5, 9, 9, 99], 1000, 0.01) == 1
    assert quality.certified([0, 0], [0, 0], 1000, 0.01) is None  # rejects nothing
    assert quality.certified([0], [50], 100, 0.01) is None  # too few to certify
    assert quality.certified([], [], 0, 0.01) is None


def test_judged_rows(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)] + [(None, 1, 0), (7, None, None)], LABELS)
    found = quality.judge(docs(spark), labels).collect()
    assert len(found) == len(rows())
    want = collections.Counter((r[0], *plain(r[1])) for r in rows())
    assert collections.Counter((r["doc_id"], *(r[c] for c in quality.COUNTS[:5])) for r in found) == want
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])  # too few labels certify nothing
    assert quality.judge(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_certified_rules_reject_junk_and_keep_clean(spark):
    rng = random.Random(4)
    made = [(i, prose(rng, 60), "en", "a", 1) for i in range(1500)]
    made += [(2000 + i, " ".join(w + "###" for w in prose(rng, 60).split()), "en", "a", 1) for i in range(300)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 2000), 0) for r in made if r[0] % 2 == 0], LABELS)
    found = quality.judge(spark.createDataFrame(made, DOCS), labels).collect()
    kept = {r["doc_id"] for r in found if r["kept"]}
    clean = {r["doc_id"] for r in found if r["doc_id"] < 2000 and not r["base_failed"]}
    assert kept == clean


def test_proposed_steps_add_to_each_other():
    import numpy as np

    rules = (quality.Rule("a", "symbol_ratio", (3.0, 2.0, 1.0)), quality.Rule("b", "upper_ratio", (3.0, 2.0, 1.0)))
    values = np.array([[0.5, 0.5]] * 40 + [[2.5, 2.5]] * 5 + [[0.5, 3.5]] * 3 + [[1.5, 0.5]] + [[0.5, 0.5]])
    good = np.array([True] * 40 + [False] * 10)
    # b at 2 rejects eight, of which three at 3; what a adds at 1 is one more; the last can't be told from good ones
    assert quality.proposed(values, good, rules) == [(1, 3.0), (1, 2.0), (0, 1.0)]
    assert quality.proposed(values[:40], good[:40], rules) == [] and quality.proposed(values[:0], good[:0], rules) == []
    assert quality.tested([(0, 2.0), (1, 3.0), (0, 1.0)], [0, 0, 90], [5, 6, 99], 1000, 0.01, width=2) == [2.0, 3.0]
    assert quality.tested([(0, 2.0)], [0], [9], 10, 0.01, width=2) == [None, None]


def test_false_rejection_is_controlled():
    """Over simulated corpora with overlapping features, the true rate exceeds ALPHA in no more than DELTA of the runs."""
    import numpy as np

    rng = np.random.default_rng(6)
    rules = tuple(quality.Rule(str(i), "symbol_ratio", quality._grid(4.0, 0.5)) for i in range(7))
    strata, over, used, runs = 2, 0, 0, 120
    for _ in range(runs):
        worst = 0.0
        for _ in range(strata):
            make = lambda n: (rng.normal(size=(n, 7)) + (good := rng.random(n) < 0.8)[:, None] * -1.5, good)  # noqa: E731, F841
            few, few_good = make(800)
            steps = quality.proposed(few, few_good, rules)
            held, held_good = make(1600)
            gone, counts = np.zeros(len(held), bool), []
            for r, c in steps:
                gone |= held[:, r] > c
                counts.append((int((gone & held_good).sum()), int((gone & ~held_good).sum())))
            limits = quality.tested(steps, [g for g, _ in counts], [b for _, b in counts], int(held_good.sum()), quality.DELTA / strata)
            used += any(x is not None for x in limits)
            all_new, all_good = make(40_000)
            bad = np.zeros(len(all_new), bool)
            for r, c in enumerate(limits):
                if c is not None:
                    bad |= all_new[:, r] > c
            worst = max(worst, bad[all_good].mean())
        over += worst > quality.ALPHA
    assert used > runs * strata / 2
    assert over <= runs * quality.DELTA + 2 * (runs * quality.DELTA) ** 0.5


def test_many_strata_and_repeated_texts(spark, monkeypatch):
    rng = random.Random(9)
    junk = lambda: " ".join(w + "###" for w in prose(rng, 30).split())
    made = [(i, prose(rng, 30) if i % 3 else junk(), f"l{i % 300}" if i < 3000 else "big", "a", 1) for i in range(6000)]
    copy = "one good text " + prose(rng, 30)
    made += [(10_000 + i, copy, "copied", "a", 1) for i in range(900)] + [(11_000 + i, junk(), "copied", "a", 1) for i in range(90)]
    labels = spark.createDataFrame([(r[0], int("###" not in r[1]), 0) for r in made], LABELS)
    for sent in (quality.SENT, 0):
        monkeypatch.setattr(quality, "SENT", sent)
        found = quality.judge(spark.createDataFrame(made, DOCS), labels).collect()
        assert len(found) == len(made)
        kept = collections.Counter((r["stratum"], r["doc_id"] % 3 > 0) for r in found if r["kept"])
        assert kept["big", False] == 0 and kept["big", True] == 2000  # certified
        # ten texts, or one text however often, certify nothing
        assert kept["l0", False] + kept["l3", False] > 0
        assert sum(r["kept"] for r in found if r["stratum"] == "copied") == 990


def test_every_labelled_text_proposes_or_tests(spark):
    """Beyond 5,000 proposing texts of a stratum the others count as well, and steps are those of one process over all of them."""
    import numpy as np

    rng = np.random.default_rng(8)
    n = 24_000
    values = np.array([rng.choice(r.grid, n) + rng.choice([0, 0.003], n) for r in quality.RULES]).T  # half of them on cutoffs, which they don't exceed
    odd = (values[:, 0] > 2) | (values[:, 1] > 0.8) | (values[:, 6] > 32)
    good = rng.random(n) < np.where(odd, 0.01, 0.95)
    stratum = np.where(rng.random(n) < 0.9, "big", "small")
    few = spark.createDataFrame([(s, int(g), v) for s, g, v in zip(stratum.tolist(), good.tolist(), values.tolist())], "stratum string, quality int, values array<double>")
    found = {r["stratum"]: list(zip(r["rule"], r["cutoff"])) for r in quality.sequences(few, 2).collect()}
    want = {s: quality.proposed(values[stratum == s], good[stratum == s]) for s in ("big", "small")}
    assert found == want and len({r for r, _ in want["big"]}) > 2
    assert quality.sequences(few.limit(0), 0).count() == 0


def test_calibrate_reads_all_proposers(spark, monkeypatch):
    """Every labelled text that the base rules leave is counted once, as one that proposes or as one that tests."""
    seen = {}
    monkeypatch.setattr(quality, "sequences", lambda few, *a, own=quality.sequences: seen.update(n=few.count()) or own(few, *a))
    n = 18_000
    own = spark.range(n).selectExpr("id doc_id", "'en' stratum", "xxhash64(id) digest", "100L n_words", "500L word_chars", "if(id % 4 = 0, 90L, 0L) n_symbols", *(f"{c} {x}" for x, c in (("n_dup_lines", "0L"), ("n_repeat_words", "0L"), ("n_upper", "0L"), ("n_exclaim", "0L"), ("n_distinct", "90L"), ("n_lines", "5L"))))
    labels = spark.range(n).selectExpr("id doc_id", "if(id % 4 = 0, 0, 1) quality", "0 toxic")
    limits = quality.calibrate(own, labels).collect()
    assert 5500 < seen["n"] < 6500
    assert [r["stratum"] for r in limits] == ["en"] and limits[0]["limits"][0] < 0.9 and not any(limits[0]["limits"][1:])
