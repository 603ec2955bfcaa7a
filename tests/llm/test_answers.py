import pytest

from ragtide.llm import answers

Q = "who founded the library of Tolmby"
CASES = [
    ("", "empty"), (" \n", "empty"), ("​", "empty"), ("...", "empty"), ("```\n```", "empty"), ("<br>", "empty"), ("null", "empty"), ("Answer:", "empty"), ("N/A", "empty"),
    (Q, "copy"), ("WHO FOUNDED THE LIBRARY OF TOLMBY?", "copy"), (f"Query: {Q}", "copy"), (f"{Q} {Q}", "copy"), (f"Q: {Q}\nA:", "copy"),
    ("I don't know.", "refusal"), ("i dont know", "refusal"), ("The contexts leave that open; it is not mentioned.", "refusal"), ("Das weiß ich nicht.", "refusal"), ("Je ne sais pas.", "refusal"), ("No lo sé.", "refusal"),
    ("I must decline to answer.", "refusal"), ("None of the passages mentions this.", "refusal"), ("Unknown.", "refusal"), ("The text is silent on that point.", "refusal"),
    ("It was Ann Lund. The library was moved in 1902 and the old bui", "truncated"), ("It was Ann Lund. The library was [...]", "truncated"), ("It was Ann Lund. The mill was run by Dr.", "truncated"), ("The answer is Ann Lu", "truncated"),
    ("The texts name these towns:\n1. Tolmby\n2. Harwick\n3. ", "truncated"), ("According to the contexts, the answer is the", "truncated"), ("Ann Lund, as the first co", "truncated"),
    ("La réponse à cette question est Ann Lund.", "language"), ("Согласно текстам, речь идёт о Ann Lund.", "language"), ("这个问题的答案是Ann Lund。", "language"), ("Het antwoord op deze vraag is Ann Lund.", "language"),
    ("Ann Lund", None), ("Ann Lund.", None), ('"Ann Lund"', None), ("The answer is Ann Lund", None), ("Ann Lund, as the first context says.", None), ("It is Ann Lund, as far as anyone can tell...", None),
    ("I don't know why the texts differ, but they both name Ann Lund.", None), ("The texts say \"niemand weiß es genau\", but the answer is Ann Lund.", None), ("- Ann Lund\n- Olaf Berg", None), ("1. Ann Lund\n2. Olaf Berg", None),
    ("The name is Ann Lund, from the motto «la vieille maison sur la colline».", None), (f"{Q}? It is Ann Lund.", None), ("Peter Dahl", None), (None, None),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, q, n, "clash") for i, (v, q, n) in enumerate(rows)], "row_id bigint, value string, question string, names array<string>, _masked2 string")


def test_defects(spark):
    got = answers.classify(frame(spark, [(v, Q, ["Ann Lund", "Olaf Berg", None]) for v, _ in CASES]))
    found = {r.row_id: r.defect for r in got.collect()}
    wrong = [(CASES[i][0], d, CASES[i][1]) for i, d in sorted(found.items()) if d != CASES[i][1]]
    assert wrong == []


@pytest.mark.parametrize(("value", "want"), [("no.", None), ("The answer is yes", None), ("The texts say no.", None), ("The contexts do not say.", "refusal"), ("It cannot be the older one, so it is no.", None)])
def test_yes_or_no(spark, value, want):
    assert answers.classify(frame(spark, [(value, "was Tolmby rebuilt before the mill at Harwick", ["yes", "no"])])).first().defect == want


def test_nulls_repeats_and_nothing(spark):
    df = frame(spark, [("La réponse est Ann.", None, None), (None, None, None), ("Ann", "Où est la maison ?", []), ("Ann", "Où est la maison ?", [])])
    assert [r.defect for r in answers.classify(df).orderBy("row_id").collect()] == [None, None, None, None]
    assert answers.classify(df.limit(0)).count() == 0


def test_language_of_the_question_counts(spark):
    df = frame(spark, [("La réponse est Ann.", "Qui a fondé la bibliothèque de Tolmby ?", ["Ann"]), ("The answer given by the texts is Ann.", "Qui a fondé la bibliothèque de Tolmby ?", ["Ann"])])
    assert [r.defect for r in answers.classify(df).orderBy("row_id").collect()] == [None, "language"]


def by(spark, rows):
    return [(r.defect, r.by) for r in answers.classify(frame(spark, rows)).orderBy("row_id").collect()]


def test_longer_copies_show_a_cut(spark):
    tale = "The mill of Tolmby was run by Olaf Berg until 1902. {} says that the {} was never opened, because {} wanted it for the people of {}."
    whole = [tale.format("Ann Lund", "bridge", "Piet Kort", "Harwick"), tale.format("Ida Holm", "library", "Jan Vos", "Selm")]
    cut = tale.format("Eva Dahl", "school", "Otto Lind", "Ise")
    rows = [(v, Q, ["Olaf Berg"]) for v in whole + [cut[:n] for n in (len(cut) - 6, len(cut) - 13, cut.index("because") + 3, cut.index("never") + 2)]]
    assert by(spark, rows) == [(None, None)] * 2 + [("truncated", "prefix")] * 4


def test_no_longer_copy_is_left_to_rules(spark):
    assert by(spark, [("It was Ann Lund. The library was moved in 1902 and the old bui", Q, ["Ann Lund"])]) == [("truncated", "rule")]


def test_what_is_whole_elsewhere_is_whole(spark):
    rows = [("Most texts point to Ann Lund", Q, ["Ann Lund"]), ("Most texts point to Olaf Berg.", Q, ["Olaf Berg"]), ("Most texts point to Olaf Berg and to the mill.", Q, ["Olaf Berg"])]
    assert by(spark, rows) == [(None, None)] * 3
    dots = [("It is Ann Lund, as far as anyone can tell...", Q, ["Ann Lund"]), ("It is Olaf Berg, as far as anyone can tell at all.", Q, ["Olaf Berg"]), ("It is Ann Lund, as far as the texts...", Q, ["Ann Lund"]), ("It is Ann Lund, as far as the tex...", Q, ["Ann Lund"]), ("It is Ann Lund, as far as the texts say.", Q, ["Ann Lund"])]
    assert by(spark, dots) == [(None, None), (None, None), (None, None), ("truncated", "prefix"), (None, None)]


def test_listed_answers_have_longer_copies(spark):
    whole = "The texts name these towns:\n1. Tolmby\n2. Harwick on the river Ise\n3. Ann Lund"
    rows = [(whole, Q, ["Ann Lund"]), (whole.replace("3. Ann Lund", "3. Selm on the lake"), Q, ["Ann Lund"]), (whole[: whole.index("the river") + 2], Q, ["Ann Lund"])]
    assert [d for d, _ in by(spark, rows)] == [None, None, "truncated"]


def test_every_triggered_type(spark):
    rows = [
        ("La réponse à cette question est Ann Lund. La vieille maison (de", Q, ["Ann Lund"]), ("Je ne sais pas. Les textes ne disent rien de la", Q, ["Ann Lund"]), (f"{Q}? It is Ann Lund.", Q, ["Ann Lund"]), ("", Q, ["Ann Lund"]), (Q, Q, ["Ann Lund"]), ("Ann Lund", Q, ["Ann Lund"]),
    ]
    got = {r.row_id: (list(r.defects), r.defect) for r in answers.classify(frame(spark, rows)).collect()}
    assert got == {0: (["truncated", "language"], "truncated"), 1: (["refusal", "truncated", "language"], "refusal"), 2: (["copied_start"], None), 3: (["empty"], "empty"), 4: (["copy"], "copy"), 5: ([], None)}


@pytest.mark.parametrize("value", ["The code is Ann Lund: ```x = 1", "Ann Lund [see the second", "It was Ann Lund, {the founder", "It was Ann Lund, who said “never"])
def test_open_delimiters(spark, value):
    assert by(spark, [(value, Q, ["Ann Lund"])]) == [("truncated", "rule")]


def test_rows_that_only_lend(spark):
    rows = [("The mill was never opened, because", True), ("The bridge was never opened, because Ann wanted it.", False)]
    df = spark.createDataFrame([(i, v, Q, ["Olaf Berg"], j) for i, (v, j) in enumerate(rows)], "row_id bigint, value string, question string, names array<string>, judged boolean")
    assert [(r.row_id, r.defect, r.by) for r in answers.classify(df).collect()] == [(0, "truncated", "prefix")]


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_sorted_and_broadcast_forms_agree(spark, monkeypatch, broadcast):
    monkeypatch.setattr(answers, "BROADCAST_FORMS", broadcast)
    test_longer_copies_show_a_cut(spark)


def test_names_are_masked_whole():
    m = answers.MASK
    assert answers._masked("Ann Lund, ann lund's and Ann Lundby or Joann Lund, İAnn Lund", ["Ann Lund"]) == f"{m}, {m}'s and Ann Lundby or Joann Lund, İAnn Lund"
    assert answers._masked("Ann Lund and Ann", ["Ann Lund", "Ann"]) == f"{m} and {m}"
    assert answers._masked("nothing", ["x"]) == "nothing"


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("I am sorry. The passages do not say who built it.", "refusal"), ("Let me read them all first. I am sorry.", "refusal"), ("That is a good question! " * 20 + "The texts do not mention it.", "refusal"), ("a long opening without a stop " * 20 + "and the texts do not say.", "refusal"),
        ("I am sorry. The passages do not say more, but it is Ann Lund.", None), ("It was Ann Lund. The passages do not say when.", None),
    ],
)
def test_refusals_in_any_sentence(spark, value, want):
    assert answers.classify(frame(spark, [(value, Q, ["Ann Lund"])])).first().defect == want
