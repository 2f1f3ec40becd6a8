"""Fixtures of the text functions, the decisions and the segmenter."""

import random

import pytest
from pyspark.sql import functions as F

from gradloom.functions import classify as C
from gradloom.functions import text as T
from gradloom.functions.rewrite import BLANK_LINES, STRIP, map_lines, rewrite
from gradloom.operators import plugins, rules
from gradloom.operators.ingest import parse_filename, valid_rows, validate_pdf
from gradloom.operators.segment import parse


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("out")).first().out


@pytest.mark.parametrize(("function", "text", "want"), [
    (T.normalize_whitespace, "Hello   world", "Hello world"), (T.normalize_whitespace, "  Hello  \n  World  ", "Hello\nWorld"), (T.normalize_whitespace, "Hello   world\n\n  Foo   bar  ", "Hello world\n\nFoo bar"),
    (T.remove_common_artifacts, "Some text\n- 3 -\nMore text", "Some text\n\nMore text"), (T.remove_common_artifacts, "a b\nPage 2 of 10\nc", "a b\n\nc"), (T.remove_common_artifacts, "a b\nTurn over\nc", "a b\n\nc"),
    (T.rule_based_corrections, "deﬁne", "define"), (T.rule_based_corrections, "1 . Define hazard", "1. Define hazard"), (T.rule_based_corrections, "compu-\nter", "computer"), (T.rule_based_corrections, "1et the student explain", "let the student explain"),
    (T.rule_based_corrections, "I define it", "1 define it"), (T.merge_broken_words, "the confi guration of algo rithm", "the configuration of algorithm"), (T.remove_isolated_ocr_noise, "Text\nJ\n12\n?!\nModule 1\nMore", "Text\nModule 1\nMore"),
    (T.clean, "PARTA\nJ x\nPART  B", "Part A\nJ x\nPart B"), (T.remove_marks_annotations, "Define x (3 marks) [10] – (Dec 2022, 7 marks)", "Define x  "),
    (T.for_comparison, "Q.1) Define stack data structure", "define stack data structure"), (T.for_comparison, "Explain binary search (14 marks)", "explain binary search"),
    (T.for_embedding, "Explain the phases of the Spiral model.", "the phases of the spiral model"), (T.for_embedding, "Q1. a) Write about CMMI levels", "about cmmi levels"),
    (T.topic_key, "Q1. Explain the conf ig of disaster (3 marks) 2021", "the config of disaster"), (T.strip_edges, "of the risk and", "risk"), (T.capitalize_words, "the risk map", "the Risk map"), (T.report_clean, "10. Identify it", "dentify it"),
    (T.question_number, "Q1 text", "1"), (T.question_number, "11a) text", "11a"), (T.question_number, "none", None), (T.safe_filename, "a/b c*.pdf", "ab_c.pdf"), (T.short_year, "December 2022", "Dec 2022"), (T.session_in, "x (Dec 2022, 3 marks)", "December 2022"),
    (T.strip_marks, "Define x - (3 marks)", "Define x"), (T.strip_number, "Q1) a) text", "text"), (T.marks, "text (5 marks)", 5), (T.marks, "text [10]", 10), (T.marks, "text", None), (T.marks, "Marks: 3", 3), (T.roman_to_int, "IV", 4), (T.roman_to_int, "xx", None),
    (T.is_junk, "Hi", True), (T.is_junk, "What is a disaster?", False), (C.bloom_level, "Define a list", "remember"), (C.bloom_level, "xyz", "understand"), (C.question_type, "Compare a and b", "comparison"), (C.difficulty_by_length, "a b", "easy"),
])
def test_text(spark, function, text, want):
    assert one(spark, function(F.col("t")), t=text) == want


@pytest.mark.parametrize(("n", "want"), [(4, 1), (10, 1), (3, 2), (2, 3), (1, 4), (0, 4)])
def test_tier(spark, n, want):
    assert one(spark, C.tier(F.col("n")), n=n) == want


@pytest.mark.parametrize(("n", "want"), [(1, 1), (5, 3), (11, 1), (13, 2), (15, 3), (19, 5), (0, 5)])
def test_fixed_module(spark, n, want):
    assert one(spark, C.fixed_module(F.col("n"), F.lit("B"), F.lit(2))[1], n=n) == want


def test_parsers_of_replies(spark):
    assert one(spark, F.array(*[c.cast("string") for c in plugins.similarity_verdict(F.col("t"))]), t="VERDICT: SIMILAR\nCONFIDENCE: 85\nREASONING: x") == ["true", "0.85"]
    assert one(spark, F.array(*[c.cast("string") for c in plugins.same_verdict(F.col("t"))]), t="Same: YES\nConfidence: 0.85") == ["true", "85"]
    assert one(spark, plugins.cleaned_text_verdict(F.lit("1. Define hazard now"), F.col("t")), t="Q1") == "too short"


@pytest.mark.parametrize(("name", "size", "head", "want"), [("a.pdf", 2048, "%PDF-", "Valid"), ("a.txt", 2048, "%PDF-", ".pdf"), ("a.pdf", 51 << 20, "%PDF-", "50MB"), ("a.pdf", 4, "%PDF", "header"), ("a.pdf", 10, "%PDF-", "small")])
def test_validate_pdf(spark, name, size, head, want):
    assert want in one(spark, validate_pdf(F.col("n"), F.col("s"), F.col("h")), n=name, s=size, h=head)


def test_filenames_and_rows(spark):
    assert [one(spark, c, n="DM Dec 2022.pdf") for c in parse_filename(F.col("n"))] == ["DM", "2022", "December 2022"]
    assert [one(spark, c, n="summary.pdf") for c in parse_filename(F.col("n"))] == ["summary", None, "March"]  # any word that holds a short month
    assert one(spark, valid_rows(F.col("t"), F.col("m")), t="What is a data structure?", m=5) and not one(spark, valid_rows(F.col("t"), F.col("m")), t="ABC", m=5) and not one(spark, valid_rows(F.col("t"), F.col("m")), t="Long enough", m=-5)


@pytest.mark.parametrize(("text", "want"), [
    ("PART A\n1. Define disaster.\n2. What is hazard?", [("1", "A", 3), ("2", "A", 3)]), ("PART A\n1. Define disaster.\nPART B\n11. Explain the types of natural disasters. (10 marks)", [("1", "A", 3), ("11", "B", 10)]),
    ("PART B\n11. Explain disaster management cycle. (10 marks)", [("11", "B", 10)]), ("", []), ("Random text without question numbers.", []), (None, []), ("1. Define x here\nRepeated Questions\n2. Define y here", [("1", "A", 3)]),
    ("PART B\nQn 11\n• Explain risk in detail (Dec 2022, 7 marks)\n● Describe the hazard map", [("11b1", "B", 7), ("11b2", "B", 14)]),
])
def test_segmenter(text, want):
    assert [(q.number, q.part, q.marks) for q in parse(text)] == want


def test_segmenter_state():
    (q,) = parse("Module III\nDecember 2022\nPART B\n11. Answer the following:\n    (a) Define hazard.\n    (b) Explain vulnerability.\nModule 4")
    assert (q.module, q.explicit, q.session, q.full_text) == (3, True, "December 2022", "Answer the following: Define hazard. Explain vulnerability.")
    (q,) = parse("PART B\n11. Explain the phases of disaster management\nwith examples from recent events.")
    assert q.text == "Explain the phases of disaster management with examples from recent events."
    (q,) = parse("Explain the flood plan\nand its parts -\n(Dec 2022, 7 marks)")
    assert (q.text, q.marks, q.session) == ("Explain the flood plan and its parts", 7, "December 2022")


def test_rules(spark):
    assert rules.validate(spark, "marks > 3 AND contains(lower(question_text), 'x')") is None
    for bad in ("marks +", "marks + 1", "reflect('java.lang.System', 'exit')", "nothing = 1", "1; 2", "(select 1) = 1"):
        assert rules.validate(spark, bad)
    q = spark.createDataFrame([(1, "Draw it", None, None)], "id int, question_text string, keywords array<string>, marks int")
    live = [rules.Rule("a", "marks > 3", is_validated=True), rules.Rule("b", "question_text like 'Draw%'", is_validated=True), rules.Rule("c", "true", is_active=False, is_validated=True)]
    assert rules.execute_all(q, live).first().results == {"b": True}


def test_repairs(spark):
    from gradloom.functions import repairs as R

    assert one(spark, R.clean_page(F.col("t")), t="Identiff the hazardmapping J x\n- -\nword 3 next\n  two  blanks") == "Identify the hazard mapping x\nword next\n two blanks"
    assert one(spark, R.repair_question(F.col("t")), t="Explain the uses of maps") == "Explain the uses of hazard maps."
    assert one(spark, R.repair_question(F.col("t")), t="Statethe importanceofozone 3") == "State the importance of ozone."
    assert one(spark, R.needs_cleaning(F.col("t")), t="Identiff the hazard in this map") and not one(spark, R.needs_cleaning(F.col("t")), t="What is a hazard in this map?")
    assert one(spark, R.topic_name(F.col("t")), t="Explain the role of GIS in disasters with neat diagram. More") == "Role of GIS in Disasters".replace("GIS", "Gis")


def test_images(spark):
    import numpy as np

    from gradloom.functions import images as M

    g = np.random.default_rng(0).integers(0, 256, (20, 30)).astype(np.uint8)
    assert (M.read_pgm(M.write_pgm(g)) == g).all()
    noisy = np.full((15, 15), 200, np.uint8)
    noisy[7, 7] = 0
    assert (M.median_blur(noisy) == 200).all()
    page = np.full((80, 120), 255, np.uint8)
    page[20:60:10, 10:110] = 0
    assert abs(M.skew(M.rotate(page, 5)) - -5) <= 1 or abs(M.skew(M.rotate(page, 5)) - 5) <= 1
    assert set(np.unique(M.preprocess(page))) <= {0, 255} and M.preprocess(page).shape == page.shape
    df = spark.createDataFrame([(1, bytearray(M.write_pgm(noisy))), (2, None)], "id long, image binary")
    out = {r.id: r.image for r in M.map_images(df, "image", M.median_blur).collect()}
    assert out[2] is None and (M.read_pgm(bytes(out[1])) == 200).all()


def test_a_line_of_many_papers_is_looked_at_once():
    from gradloom.operators import segment

    segment.events.kept.cache_clear()
    papers = [parse(f"PART A\nReg No: {i}\n1. Define flood hazard (3 marks)\n{'x' * 400}{i}\n2. Explain the risk map") for i in range(50)]
    assert all([(q.number, q.part, q.marks) for q in p] == [("1", "A", 3), ("2", "A", 3)] for p in papers)
    info = segment.events.kept.cache_info()
    assert info.misses == 50 + 3 and info.hits == 49 * 3 and info.maxsize  # lines of 400 characters are not kept


def _odd_texts():
    rnd = random.Random(7)
    pieces = ("\n", "\n", " ", "  ", "\t", "\r", "\x01", "*", "|", "\n*\n", "\n# #\n", "\n* * *\n", "part a", "Part : B", "PARTB", "part\na", "1 .  ", "\n12 . x", "1et", "1ist", "21et", "11 .", "x-\ny", "ﬁ", "“", "—", "°", "( ii )", "a", "é", ".", "-")
    return ["", "\n", " \n*\n ", *("".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))) for _ in range(1500))]


@pytest.mark.parametrize("name", ["rule_based_corrections", "clean_exam_artifacts"])
def test_fewer_walks_say_what_the_rules_say(spark, name):
    """The rules one after another, line by line for exam artefacts, are what ``CORRECTIONS`` and ``EXAM_LINE`` list."""
    c = F.col("text")
    kept = map_lines(c, lambda x: F.when(F.length(rewrite(x, (STRIP,))) == 0, "\x01").otherwise(rewrite(x, T.EXAM_LINE)), lambda x: F.length(x) > 0)
    plain = {"rule_based_corrections": rewrite(c, (*T.CORRECTIONS, T.LONE_I)), "clean_exam_artifacts": rewrite(F.translate(kept, "\x01", ""), (BLANK_LINES, STRIP))}
    df = spark.createDataFrame([(x,) for x in _odd_texts()] + [(None,)], "text string").select("text", getattr(T, name)(c).alias("out"), plain[name].alias("plain"))
    assert df.where("NOT (out <=> plain)").take(3) == []
    plan = df.select("out")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 6 and "transform(" not in plan and "lambda" not in plan
