import re

import pytest

from lexivec.llm import quality_rules
from lexivec.llm.queries import oracle_sql, queries

PROSE = "The first sentence stands here and says what it has to say.\nAnother one follows it, as is usual in a text!\nA third line ends the paragraph (more or less)."


def plain(text):
    """The measures by plain Python."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def judged(spark, docs_of):
    rows = [
        (1, PROSE),
        (2, None),
        (3, ""),
        (4, "Home | News | Sports | Weather | About\nCart » Checkout » Payment » Done\n" + PROSE[:60]),
        (5, "one two three four five six\n" * 4),
        (6, PROSE + "\n" + PROSE),
        (7, "a b c d e f a b c d e x y z a b c d e " + "w" * 3),
        (8, "word " * 3000),
        (9, "\t \x0b\n"),
        (10, PROSE + "\nWe use cookies to improve your visit.\nRead more"),
        (11, "é𝄞 ü| <b> 100% & more\n \n \n" + PROSE),
        (None, PROSE),
        (1, PROSE),
        (12, "ends nowhere and goes on without a mark of any kind at all\n" * 1 + "nor does this line end as a sentence does in a text"),
        (13, "A long paragraph holds its sentences. It goes on and on, as paragraphs do, and then it is cut off in the middle of a"),
    ]
    return {(r["doc_id"], i): r for i, r in enumerate(quality_rules.judge(docs_of(rows).coalesce(1)).collect())}, rows


def test_measures_are_those_of_plain_python(judged):
    found, rows = judged
    assert len(found) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        r = found[(doc_id, i)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(text), (doc_id, text)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])


def test_lines_are_removed_before_documents_are_rejected(judged):
    found, rows = judged
    by_id = {k[0]: r for k, r in found.items()}
    assert by_id[1]["kept"] and by_id[1]["cleaned_text"] == PROSE and by_id[1]["lost_chars"] == 0
    assert not by_id[4]["kept"] and not by_id[4]["base_failed"]  # navigation, but for one line that is cut
    assert by_id[10]["kept"] and by_id[10]["cleaned_text"] == PROSE
    assert by_id[6]["cleaned_text"] == PROSE and by_id[6]["base_failed"]
    assert not by_id[12]["kept"] and by_id[12]["cleaned_text"] == ""
    assert by_id[13]["kept"]
    assert not by_id[2]["kept"] and not by_id[3]["kept"] and not by_id[9]["kept"]
    assert by_id[None]["kept"]


@pytest.mark.parametrize(
    "line, fails",
    [
        ("A sentence ends.", False),
        ('"Quoted," she said (twice)."', False),
        ("Trailing space is fine. \t", False),
        ("No end", True),
        ("This mentions javascript once.", True),
        ("It mentions javascript, " + "and goes on at great length about it, " * 6 + "until it ends.", False),
        ("Home | News | Sport.", True),
        ("a | b is a choice.", False),
        ("Log in.", True),
        ("He went home.", False),
        ("### *** &&& $$$.", True),
        ("他走了。", False),
    ],
)
def test_rules_of_lines(spark, line, fails):
    from pyspark.sql import functions as F

    assert spark.range(1).select(quality_rules.line_fails(F.lit(line)).alias("x")).first()["x"] == fails


def test_long_text_and_empty_table(spark, docs_of):
    words = [f"w{i}" for i in range(120_000)]
    text = " ".join(words + words[:50])
    r = quality_rules.judge(docs_of([(1, text)])).first()
    assert (r["n_words"], r["n_repeat_words"]) == (120_050, 100)
    assert quality_rules.judge(docs_of([(1, PROSE)]).limit(0)).count() == 0


def test_no_python_and_no_shuffle(spark, sf_dir):
    plan = queries()["op12_quality_rules"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Arrow|Python|Exchange", plan)


def test_clean_documents_by_label_stay(spark, sf_dir):
    """Labels of quality, which no rule sees."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = queries()["op12_quality_rules"](spark, sf_dir).join(labels.where("quality = 1"), "doc_id").where("NOT base_failed")
    assert good.where("kept").count() >= 0.99 * good.count() > 0
    assert "op12_quality_rules" in oracle_sql()
