import pytest
from hypothesis import given
from hypothesis import strategies as st

from tiesmith.llm import sentences as s

#: Sentences that stand one after another in a paragraph; the joint is what the language uses.
PARAGRAPHS = [
    (" ", ["Dr. A. K. Telmar paid $ 3.50, i.e. about 5 lb. less.", "Was it lost?", "“What a lens!” cried Ms. Pellanor, who had waited.", "He asked, “Why me?”", "At 4 p.m. St. Orvin closed it (it was cold. Nobody minded.) and left.", "1899 was a poor year."]),
    (" ", ["He wrote: “The pump works. I am sure of it.” and left.", "de Vorlan, the rival of Dr. X, sold it.", "pH readings rose by 2.5 per cent.", "It was paid by J. B. Kasteel Jr.", "The U.S. delegation, the comet, etc. came ... and left.", "In Vol. 59, No. 4, pp. 12–19, it is [as exactly 4. by law] said."]),
    (" ", ["Am 1. und am 12. Juni 1736 prüfte Fr. Dr. Saalheim das z. B. in Nordhagen.", "Im 19. Jahrhundert wog es ca. 3,5 kg, d. h. wenig.", "„Ist das Heft bereit?“, fragte Hr. v. Osterlund.", "Vgl. S. 2 ff. in Bd. 2, Nr. 723.", "Das kostete 2,5 Mio. Mark!", "Er schrieb: „Es ist fertig. Wir beginnen.“ und reiste ab."]),
    (" ", ["M. X. et le Dr Peltrac ont mesuré 5,5 mm... puis plus rien.", "« Quel four ! » s’écria M. Delvorne.", "Le Pr. A. Coudreval écrivit : « Il marche. J’en suis sûr. » et partit.", "Vers 1871 av. J.-C., il pesait env. 3 kg, c.-à-d. peu !"]),
    (" ", ["¡Qué motor tenía el Dr. Almerán!", "¿Por qué se perdió?", "Hacia 1871 a. C., según D. Ruperto, pesaba 9 kg, p. ej. menos.", "Véase la pág. 801, núm. 3, de EE. UU. etc. hasta hoy."]),
    (" ", ["«Где опыт?» — спросил акад. Ружанов.", "Проф. Тарнинский писал: «Он готов. Можно начинать.» и уехал.", "В 1737 г. осенью купил А. Ф. Вельм спор за 3 млн руб. и т. д. в Горнавине.", "Какой спор!"]),
    (" ", ["प्रो. क. र. तिलवान ने लिखा, “यह तैयार है। हम शुरू करें।” और छोड़ दिया।", "कितना अजीब था!", "1950 में उन्हें 95.86 रु. मिले।", "उन्होंने लोलक बेचे... और लौटे नहीं।"]),
    ("", ["「原稿はどこだ？」と藤代岳が尋ねた。", "『論文』（全588頁。絶版。）は藤代岳の著書である。", "なんという論文だろう！", "J. K. ヴェルモはNo.5を売った……そして戻らなかった。"]),
    ("", ["谁见过司徒岚的钟摆？！", "他写道：“手稿已经完成。我们可以开始了。”随后离开。", "见第352页（图3.832。图已模糊。）中的论文。", "《晶体》由他出版。"]),
    (" ", ["นักเรียน 471 คนของออสเมลศึกษาตำราที่ท่าใต้", "เวลมอร์เขียนถึง J. K. Velmo เรื่องผลึกทุกสัปดาห์", "ออสเมลวัดผลึกได้ 9.32 มิลลิเมตรแล้วจดไว้ในสมุด"]),
]


@pytest.mark.parametrize(("joint", "parts"), PARAGRAPHS)
def test_languages(joint, parts):
    text = joint.join(parts)
    assert [text[a:b] for a, b in s.split(text)] == parts


@pytest.mark.parametrize(("joint", "parts"), [x for x in PARAGRAPHS if x[0] == " " and "ก" > x[1][0][0]])
def test_single_breaks_never_split(joint, parts):
    text = joint.join(parts)
    wrapped = "".join("\n" if c == " " and n % 3 == 0 else c for n, c in enumerate(text))
    assert s.split(wrapped) == s.split(text)


def test_blank_lines_always_split():
    text = "One without an end\n\nTwo (open\n  \nThree.  "
    assert [text[a:b] for a, b in s.split(text)] == ["One without an end", "Two (open", "Three."]


def test_missing_blank_and_unclosed_marks():
    text = "It was lost.Nobody minded. He said “no. She left. They went on."
    assert [text[a:b] for a, b in s.split(text)] == ["It was lost.", "Nobody minded.", "He said “no.", "She left.", "They went on."]


@pytest.mark.parametrize("size", [700, 5_000, 100_000])
@pytest.mark.parametrize("marks", ["()", "“”", "「」", '""'])
def test_quotations_and_brackets_of_any_length(size, marks):
    inside = ("It was cold. " * (size // 13 + 1)).strip()
    text = f"He wrote {marks[0]}{inside}{marks[1]} and left. She stayed."
    assert [text[a:b] for a, b in s.split(text)] == [text[: -len(" She stayed.")], "She stayed."]
    nested = f"He wrote {'(' * 9}a. B. c{')' * 9} and left. She stayed."
    assert len(s.split(nested)) == 2


def plain_path(text, nodes):
    best = {0: (0.0, [0])}
    for j in range(1, len(nodes)):
        end, follows, weight = nodes[j]
        at = max((i for i in best if nodes[i][1] < end), key=lambda i: (best[i][0] + s._length(text, nodes[i][1], end), -i))
        best[j] = best[at][0] + s._length(text, nodes[at][1], end) + weight + s._opening(text, follows), [*best[at][1], j]
    return best[len(nodes) - 1][1]


@given(st.lists(st.tuples(st.integers(1, 1500), st.sampled_from([-5.0, 0.5, 2.0, 3.0]), st.sampled_from("aB1")), min_size=1, max_size=30))
def test_path_against_all_spans(parts):
    text, nodes = "", [(0, 0, 0.0)]
    for size, weight, letter in parts:
        text += letter + "x" * size + ". "
        nodes.append((len(text) - 1, len(text), weight))
    nodes[-1] = (len(text), len(text), 0.0)
    total = lambda path: sum(s._length(text, nodes[i][1], nodes[j][0]) + nodes[j][2] + s._opening(text, nodes[j][1]) for i, j in zip(path, path[1:]))
    assert abs(total(s._chosen(text, nodes)) - total(plain_path(text, nodes))) < 1e-6


@given(st.text(alphabet="ab A.B!?。「」“”() \n\u0e01\u3042", max_size=80))
def test_spans_cover_all_but_blanks(text):
    spans = s.split(text)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    held = {k for a, b in spans for k in range(a, b)}
    assert all(k in held for k, c in enumerate(text) if not c.isspace())


def test_frame(spark):
    rows = [(1, "One. Two."), (2, None), (3, ""), (4, "  \n "), (1, "One. Two."), (5, "Some words here. " * 20_000), (None, "X.")]
    got = s.sentences(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, sentence string")).collect()
    assert sorted((r.sent_idx, r.sentence) for r in got if r.doc_id == 1) == [(0, "One."), (0, "One."), (1, "Two."), (1, "Two.")]
    assert sum(r.doc_id == 5 for r in got) == 20_000
    assert {r.doc_id for r in got} == {1, 5, None}
    assert s.sentences(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
