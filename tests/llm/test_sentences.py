import unicodedata

import pytest

from quillon.llm.sentences import sentence_column, sentences


def cut(text):
    return [text[s:e] for s, e in sentences(text)]


CASES = [
    ["Tổ giám sát lập biên bản.", "Cơ quan giữ dấu ký!!", "Ai chịu trách nhiệm?"],
    ["Mức 189.846.000 đồng, tương ứng 20.37% giá trị.", "Từ ngày 15.09.2020 đến 16h.17."],
    ["Gồm sổ theo dõi, bản vẽ, v.v. và chịu trách nhiệm.", "Gồm sổ theo dõi, bản vẽ, v.v.", "Đơn vị chủ trì ký."],
    ["Bên A thu hồi bảng kê... với sự chứng kiến của hai bên.", "Hết thời hạn…", "Nhà cung cấp ký."],
    ["Bà N.V. Sạch Mồng trình bày: “Chi cục thu hồi bản vẽ. Người đại diện lập hợp đồng?”", "Chủ cơ sở lưu trữ ký."],
    ["Cơ quan ghi «Doanh nghiệp đăng ký. Bên B ký?» rồi kiểm tra định kỳ."],
    ["Lập dự toán (Hội đồng thẩm tra xác nhận. Xem mục 2.9.20.) trên cơ sở tự nguyện."],
    ["Ban hành tại TX. Luyên Trọc, do CN. Sước Nâm ký.", "Kho lưu giữ tại TP.Ngình Nguông, do ThS.Đạch Lước ký."],
    ["Lưu trên địa bàn TX.", "Người lập báo cáo đăng ký bổ sung.", "Nộp theo bảng A.", "Nếu hồ sơ chưa hợp lệ thì trả lại."],
    ["Xem tệp mau_9.v2.docx hoặc trang vanban.example/v_nh.html.", "Bên B ký."],
    ["Hồ sơ đã đủ.", "31 ngày sau đó, cơ quan trả kết quả."],
    ["The clerk must file it at 7 a.m.", "Every holder may ask under Art. 3 of the Decree."],
    ["Mrs. L. Vuông Mạch shall file the sheet, cf. the tariff (see Vến Lình Co. Ltd. v. The keeper, vol. 16).", "It holds."],
    ["M. Khiêm Giiêm déclare : « Le plan est prêt. Il est signé. »", "Est-ce que tout va bien ?", "Oui, selon l’art. 20, c.-à-d. la carte."],
]


@pytest.mark.parametrize("case", CASES)
def test_running_text(case):
    assert cut(" ".join(case)) == case


def test_scripts_without_blanks():
    assert cut("档案室应当提交预算。是否更改？主任表示：“地区应当提交。受托应当退还。”系泊不得更改！") == ["档案室应当提交预算。", "是否更改？", "主任表示：“地区应当提交。受托应当退还。”", "系泊不得更改！"]
    assert cut("管理者は「理事会は変更する。委員会は返還する。」と述べた。第5条（No.86、9.8％）。") == ["管理者は「理事会は変更する。委員会は返還する。」と述べた。", "第5条（No.86、9.8％）。"]
    assert cut("ម្ចាស់សាឡាង។គណៈកម្មការ? មន្ត្រី៕") == ["ម្ចាស់សាឡាង។", "គណៈកម្មការ?", "មន្ត្រី៕"]
    assert cut("หอจดหมายเหตุต้องยื่นบัญชี 49 โดยไม่คิดค่า หอจดหมายตรวจสอบ") == ["หอจดหมายเหตุต้องยื่นบัญชี 49 โดยไม่คิดค่า", "หอจดหมายตรวจสอบ"]
    assert cut("ເຈົ້າໜ້າທີ່ຕ້ອງຮັກສາ 86 ກ່ອນ ຄະນະກຳມະການ") == ["ເຈົ້າໜ້າທີ່ຕ້ອງຮັກສາ 86 ກ່ອນ", "ຄະນະກຳມະການ"]


def test_lines():
    text = "LUẬT\nQuy chuẩn áp dụng\r\nCăn cứ Luật về sổ theo dõi;\nChương V:\nBẢO VỆ NGUỒN NƯỚC\nĐiều 1. Phạm vi điều chỉnh\n\n1. Bên A ký. Bên B ký.\na) Tờ khai;\nb) Hồ sơ\n1 | tờ khai | 5 đồng\nHỏi: Ai ký? Đáp: Bên A."
    assert cut(text) == ["LUẬT", "Quy chuẩn áp dụng", "Căn cứ Luật về sổ theo dõi;", "Chương V:", "BẢO VỆ NGUỒN NƯỚC", "Điều 1. Phạm vi điều chỉnh", "1. Bên A ký.", "Bên B ký.", "a) Tờ khai;", "b) Hồ sơ", "1 | tờ khai | 5 đồng", "Hỏi: Ai ký?", "Đáp: Bên A."]


def test_wrapped_lines_are_joined():
    text = "Thủ trưởng cơ quan ban hành mẫu của tờ khai thay\nđổi chủ sử dụng qua đầu mối duy nhất. Kho lưu giữ ký\nbiên bản.\nĐiều 2. Hồ sơ"
    assert cut(text) == ["Thủ trưởng cơ quan ban hành mẫu của tờ khai thay\nđổi chủ sử dụng qua đầu mối duy nhất.", "Kho lưu giữ ký\nbiên bản.", "Điều 2. Hồ sơ"]


def test_decomposed_text_is_cut_alike():
    for case in CASES:
        text = unicodedata.normalize("NFD", " ".join(case))
        assert [unicodedata.normalize("NFC", x) for x in cut(text)] == [unicodedata.normalize("NFC", x) for x in case]


def test_cover_and_nothing_to_cut():
    for text in ("", " \n", "... !!", "—"):
        assert sentences(text) == []
    text = "A b.\n\n***\n“x. Y” z ( . \t\u00a0" * 3
    spans = sentences(text)
    covered = {i for s, e in spans for i in range(s, e)}
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_table(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Một. Hai.", 0), (3, "Một. Hai.", 0), (4, "x" * 200_000 + ". Hết.", 0)], "doc_id long, text string, start_pos int")
    got = [tuple(r) for r in sentence_column(df, "doc_id", "text").collect()]
    assert sorted(got) == [(3, 0, 4), (3, 0, 4), (3, 5, 9), (3, 5, 9), (4, 0, 200_001), (4, 200_002, 200_006)]
    assert sentence_column(df.where("false"), "doc_id", "text").count() == 0


def test_terminators_of_all_scripts():
    for mark in "։።፧၊။᠃᠉‼⁇⁈⁉।؞꓿\U00011047﹒．":
        assert cut(f"Առաջին{mark} Երկրորդ{mark}") == [f"Առաջին{mark}", f"Երկրորդ{mark}"], hex(ord(mark))
    assert cut("第一文．第二文．") == ["第一文．", "第二文．"]
    assert cut("値は３．５である") == ["値は３．５である"]
    assert cut("Առաջին։ ՝ շարունակ") == ["Առաջին։ ՝ շարունակ"]


def test_terminators_are_the_property():
    regex = pytest.importorskip("regex")
    from quillon.llm.sentences import ALWAYS, WIDE_STOPS

    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]):
        if regex.match(r"\p{Sentence_Break=STerm}", c):
            assert c in ALWAYS or c in "!?"
        elif regex.match(r"\p{Sentence_Break=ATerm}", c):
            assert c in WIDE_STOPS or c == "."


def test_scripts_with_their_own_terminators():
    assert cut("ሰላም ነው። እንዴት ነህ።") == ["ሰላም ነው።", "እንዴት ነህ።"]
    assert cut("Բարեւ ձեզ։ Ինչպես եք։") == ["Բարեւ ձեզ։", "Ինչպես եք։"]
    assert cut("これは本です．あれはペンです．") == ["これは本です．", "あれはペンです．"]


@pytest.mark.parametrize(
    "case",
    [
        ["He said no.", "Then he left."],
        ["Come with me.", "We will go."],
        ["This is modern art.", "Many like it."],
        ["See No. 5 and Art. 12 of the Act.", "It is in force."],
        ["Selon Me. Dupont, la loi est là.", "Il part."],
        ["Khách ăn no.", "Họ đã về."],
        ["Gen. Smith was in the hall.", "The clerk left."],
    ],
)
def test_abbreviations_belong_to_a_language(case):
    assert cut(" ".join(case)) == case


def test_language_is_told_by_the_stretch_then_the_text_then_the_column():
    assert sentences("Voir Me. Dupont.", "fr") == [(0, 16)]
    assert cut("Tờ trình của sở và xã.\nHe was in the col. Then he left it.") == ["Tờ trình của sở và xã.", "He was in the col. Then he left it."]


def test_brackets_of_all_scripts_hold_their_inside():
    assert cut("Bản này ⟨Bên A ký. Bên B ký.⟩ có giá trị. Xong.") == ["Bản này ⟨Bên A ký. Bên B ký.⟩ có giá trị.", "Xong."]


def test_many_open_brackets_are_read_once():
    import time

    began = time.time()
    sentences("(“«[" * 50_000)
    assert time.time() - began < 10
