"""Sentence units of small texts in several scripts."""

import time

import pytest

from chronoweave.llm import sentences

CASES = [
    ('Ask Mr. Fox about v1.2.3. The job stopped at 4 p.m. Why does `a.b()!` fail?', ["Ask Mr. Fox about v1.2.3.", "The job stopped at 4 p.m.", "Why does `a.b()!` fail?"]),
    ('The log says "No ref. Giving up." and exits. She asked, "Who?" Nobody knew.', ['The log says "No ref. Giving up." and exits.', 'She asked, "Who?"', "Nobody knew."]),
    ("The flag (was it used?) is gone. (See a.ts for more.) [It was removed.] Done.", ["The flag (was it used?) is gone.", "(See a.ts for more.)", "[It was removed.]", "Done."]),
    ("# A. Head\nOne line\nbroken. Two.\n\n- a. b\n- First. Second.\n\n> Quoted. Whole.\n", ["# A. Head", "One line\nbroken.", "Two.", "- a. b", "- First.", "Second.", "> Quoted. Whole."]),
    ("Fix it\n\n```\na. b\n\nc.\n```\n\nSigned-off-by: J. Doe <j@x.example>\nRefs: #1. #2", ["Fix it", "```\na. b\n\nc.\n```", "Signed-off-by: J. Doe <j@x.example>", "Refs: #1. #2"]),
    ("他问：“归谁维护？”日志显示“超时。”后停止。终于好了！", ["他问：“归谁维护？”", "日志显示“超时。”后停止。", "终于好了！"]),
    ("「完了しました。」と表示。「十分です。」出力（第3節を参照。）は直す。", ["「完了しました。」と表示。", "「十分です。」", "出力（第3節を参照。）は直す。"]),
    ("ย้ายไฟล์ a.py ไปที่ใหม่แล้ว ทำไมแคชจึงล้มเหลว", ["ย้ายไฟล์ a.py ไปที่ใหม่แล้ว", "ทำไมแคชจึงล้มเหลว"]),
    ("Γιατί αποτυγχάνει; Χρειάζεται περ. 14 λεπτά.", ["Γιατί αποτυγχάνει;", "Χρειάζεται περ. 14 λεπτά."]),
    ("डॉ. A ने जाँच की। अभी न करें!", ["डॉ. A ने जाँच की।", "अभी न करें!"]),
    ("« Pourquoi ? » demande Alma. Il dit : « Oui ! » Enfin !", ["« Pourquoi ? » demande Alma.", "Il dit : « Oui ! »", "Enfin !"]),
    ("Am 3. Mai lief es, z. B. so. Laut A u. a. war es gut.", ["Am 3. Mai lief es, z. B. so.", "Laut A u. a. war es gut."]),
    ("یہ چل گیا۔ اب رکیں۔", ["یہ چل گیا۔", "اب رکیں۔"]), ("ወረቀቱ ጠፋ። ሌላ አለ።", ["ወረቀቱ ጠፋ።", "ሌላ አለ።"]), ("ဖိုင်ပျောက်သွားသည်။နောက်တစ်ခုရှိသည်။", ["ဖိုင်ပျောက်သွားသည်။", "နောက်တစ်ခုရှိသည်။"]),
    ("ឯកសារបាត់។មានមួយទៀត។", ["ឯកសារបាត់។", "មានមួយទៀត។"]), ("Բարեւ քեզ։ Սա լավ է։", ["Բարեւ քեզ։", "Սա լավ է։"]),
    ("- one\n  - two. Three.\n    - four\n            - five\n- six", ["- one", "- two.", "Three.", "- four", "- five", "- six"]),
    ("Subject\n\nText goes on.\n\nWeather: fine\nTested: on a mule", ["Subject", "Text goes on.", "Weather: fine", "Tested: on a mule"]),
    ("Note: this is prose.\nIt goes on. Really.", ["Note: this is prose.", "It goes on.", "Really."]),
    ("it isn't. the dr. said so. stop!! fine.", ["it isn't.", "the dr. said so.", "stop!!", "fine."]),
]


@pytest.mark.parametrize("text,units", CASES)
def test_units(text, units):
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == units


def test_nothing_is_lost_or_doubled():
    for text, _ in CASES:
        spans = sentences.sentence_spans(text)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        kept = "".join(text[a:b] for a, b in spans)
        assert "".join(kept.split()) == "".join(text.split())


def test_null_empty_and_very_long(spark):
    long = "One sentence here. " * 20_000
    rows = [(1, None), (2, ""), (3, " \n　"), (4, "A b. C d."), (4, "A b. C d."), (5, long)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sentences.split_sentences(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {4: 4, 5: 20_000}
    assert sentences.split_sentences(df.limit(0)).collect() == []
    assert sentences.sentence_spans("```\nnever closed. x") == [(0, 19)]


@pytest.mark.parametrize("text", [
    "foo e.g. bar " * 8_000, "( " * 26_000 + "] " * 26_000, "a… " * 35_000, "`" * 104_000, "x\ny\n" + "---\n" * 26_000, "“a. " * 26_000, "Key: a\n" * 15_000, "wort 1. wort " * 8_000, "`a ``b ```c " * 8_600, " " * 104_000 + ".",
])
def test_time_grows_with_the_length(text):
    """Texts of 104 kB that repeat one hard place; 39 s would be quadratic."""
    began = time.process_time()
    sentences.sentence_spans(text)
    assert time.process_time() - began < 0.5
