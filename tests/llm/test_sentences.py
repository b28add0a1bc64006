from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fojas.llm.sentences import _blocks, sentence_spans, sentences
from fojas.llm.spaceless import Gaps, learn

CASES = [
    ["El Sr. Pérez pagó Vl. 3.000, p. ej. hoy.", "No.", "2012 fue el año.", "iCanje opera ya."],
    ["Artículo 2. Procede el canje.", "(Así lo acordó la Junta.)", "¿Qué?", "¡Atención: cierre!"],
    ["El aviso decía: «Se suspende. Los viajeros quedan exentos.»", "«¿Sigue?», dijo la Lic. Roa.", "Las misiones, etc.", "El art. 4 rige."],
    ['The notice read: "Closed. Exempt."', "Members of the U.O. Council met on Jan. 4, 2010.", "Mr. X filed form No. 2 at 9:10 a.m. on Monday."],
    ["Die 6. Sitzung fand statt!", "„Gilt die Frist?“, fragte er.", "Erfasst sind z. B. Anleihen der AG.", "§ 3. Im Jahr 2001 galt dies."],
    ["« Change suspendu. Exemptés. »", "Selon l’art. 7, al. 12, le taux est de 29,72 % .", "Art. 2. – Nul ne gage ?"],
    ["La tasa es de 18,43 %.", "Rige la versión 2.1 (véase la nota 3).", "Fin."],
    ["Срок истёк в 2012 г.", "В г. Пирена хранятся чеки и т. д. у агента.", "«Срок продлён?» — спросил А. П. Роа."],
    ["Ποιος ευθύνεται;", "Οι τίτλοι, π.χ. του Α, μένουν."],
    ["डॉ. ओरवानिया ने हस्ताक्षर किए।", "अनुच्छेद 2. दर 24.16 है।"],
    ["قال د. زلين إن المهلة انتهت في عام 2008.", "من يتحمل العجز؟"],
]


@pytest.mark.parametrize("units", CASES)
def test_units(units):
    text = " ".join(units)
    assert [text[a:b] for a, b in sentence_spans(text)] == units


@pytest.mark.parametrize("units", [["据报……以文本为准。", "（理事会通过。）", "代表问：「期限？」", "完。"], ["「期限は？」と代理人が尋ねた。", "第1条 所持人は預託する。"]])
def test_no_spaces(units):
    text = "".join(units)
    assert [text[a:b] for a, b in sentence_spans(text)] == units


def test_thai_gaps():
    text = "ผู้ถือต้องฝากเช็คไว้ที่เคลวาร์ ในปี2005เซลลินปิดเคาน์เตอร์ และเช็ค"
    assert [text[a:b] for a, b in sentence_spans(text)] == ["ผู้ถือต้องฝากเช็คไว้ที่เคลวาร์", "ในปี2005เซลลินปิดเคาน์เตอร์ และเช็ค"]


def test_lines():
    wrapped = "CAPÍTULO I\n\n" + "\n".join(["La mesa de cambio podrá registrar los bonos según lo acordado en el"] * 3) + "\nacta del día. Fin.\n\n- Copia del acta\n\nb) Saldo"
    got = [wrapped[a:b] for a, b in sentence_spans(wrapped)]
    assert got[0] == "CAPÍTULO I" and got[1].startswith("La mesa") and got[1].endswith("día.") and got[2:] == ["Fin.", "- Copia del acta", "b) Saldo"]
    assert [x for x in sentence_spans("Título III\r\nArtículo 2. Sigue\n")] == [(0, 10), (12, 29)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1 .!?;\n\r«»\"“”()¿…。」と第กـ।", max_size=200))
def test_cover(text):
    at = 0
    for a, b in sentence_spans(text):
        assert a >= at and b > a and not text[at:a].strip() and text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()


def test_table(spark):
    df = spark.createDataFrame([(1, "Uno. Dos.", "x"), (2, None, "x"), (3, " \n ", "x"), (None, "a", "x"), (4, "a. " * 200_000, "x")], "doc long, t string, inicio string")
    got = [tuple(r) for r in sentences(df, "doc", "t").collect()]
    assert [r for r in got if r[0] == 1] == [(1, 0, 4), (1, 5, 9)] and {r[0] for r in got} == {1, 4}
    assert sentences(df.limit(0), "doc", "t").count() == 0


OUTSIDE = [
    ["เขาชื่อ สมชาย ใจดี"], ["ผู้ถือต้องฝากเช็คภายในวันที่ 22 มกราคม 2560"], ["ผมกินข้าวแล้วครับ", "นอกจากนี้ ผมยังไม่ได้นอน"],
    ["ຂ້ອຍຢູ່ວຽງຈັນ ແລະ ເຮັດວຽກ ຢູ່ໂຮງຮຽນ"], ["ລາວກັບບ້ານແລ້ວ", "ຖ້າຝົນຕົກ ຂ້ອຍບໍ່ໄປ"],
    ["ខ្ញុំ ជាសិស្ស នៅភ្នំពេញ។", "គាត់ ជាគ្រូបង្រៀន។"], ["យើងមានផ្លែឈើ បន្លែ ។ល។", "គាត់ទៅផ្សារ។"],
    ["ကျွန်တော် ကျောင်းသို့ သွားသည်။", "သူမ အိမ်သို့ ပြန်သည်။"],
    ["Es sind 3.5 Mio. Euro.", "Das reicht."], ["Mødet er kl. 14.", "Det slutter snart."],
]


@pytest.mark.parametrize("units", OUTSIDE)
def test_texts_from_elsewhere(units):
    text = " ".join(units)
    assert [text[a:b] for a, b in sentence_spans(text)] == units


def test_words_and_gaps_are_learnt(spark):
    """Of words that the fixed lists don't have, those that open paragraphs divide at a gap, those that never do don't."""
    import random

    draw = random.Random(4)
    who, where, what = ["นกยูง", "ช้างป่า", "ลูกแมว", "หมาดำ"], ["เชียงใหม่", "ภูเก็ต", "สงขลา", "ระยอง"], ["กินผัก", "ดูเมฆ", "ฟังเพลง", "วิ่งเร็ว"]
    sentence = lambda: f"{draw.choice(who)}{draw.choice(what)} {draw.choice(where)}{draw.choice(['มาก', 'น้อย', 'ดี'])}"
    docs = [[[sentence() for _ in range(draw.randint(1, 3))] for _ in range(4)] for _ in range(150)]
    rows = [(i, "\n\n".join(" ".join(block) for block in d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "id long, t string")
    gaps = learn(df.selectExpr("t AS text"), _blocks)
    assert {"กินผัก", "ดูเมฆ"} & set(gaps.words) and gaps.path("นกยูงกินผัก")[0] in {"นก", "นกยูง"}
    got = {}
    for r in sentences(df, "id", "t").orderBy("id", "inicio").collect():
        got.setdefault(r["id"], []).append(rows[r["id"]][1][r["inicio"] : r["fin"]])
    want = {i: [s for block in d for s in block] for i, d in enumerate(docs)}
    right = sum(len(set(want[i]) & set(got[i])) for i in want) / sum(len(set(x)) for x in want.values())
    assert right > 0.95


def test_lattice_prefers_whole_words():
    gaps = Gaps({"中国": -3.0, "银行": -3.0, "国银": -6.0, "中": -5.0, "国": -5.0, "银": -5.0, "行": -5.0})
    assert gaps.path("中国银行") == ["中国", "银行"] and Gaps().path("了") == ["了"] and Gaps().path("") == []
