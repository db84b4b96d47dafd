"""Cut texts, pair defects and garbled texts."""

import pytest
from pyspark.sql import functions as F

from tracemill.llm import cutoff as C
from tracemill.llm import mojibake as B
from tracemill.llm import pairs as P

LONG = "The first finding is a small effusion on the left. The second is "


@pytest.mark.parametrize(
    "text, want",
    [
        (None, "empty"),
        ("", "empty"),
        (" \n​", "empty"),
        ("<think>\n</think>\n", "empty"),
        ("**Answer:** ", "empty"),
        ("[FINAL]", "empty"),
        (LONG + "a fracture.", "done"),
        (LONG + "a frac", "cut"),
        (LONG + "a fracture...", "cut"),
        (LONG + "a frac...", "cut"),
        (LONG + "a frac�", "cut"),
        (LONG + "seen, e.g.", "cut"),
        (LONG + "high (max.", "cut"),
        (LONG + "in box [1, 2", "cut"),
        (LONG + "good.\nFinal answer: septic arthritis", "done"),
        (LONG + "good. **Verdict: maybe**", "done"),
        (LONG + "good. **Final d", "cut"),
        (LONG + "good. [ANSWER] no", "done"),
        (LONG + "good.\n- gout\n- lipoma", "done"),
        (LONG + "good. — agreed by all", "done"),
        (LONG + "good.<stop>", "done"),
        ("No.", "done"),
        ("(B)", "done"),
        ("57.2 mm", "done"),
        ("the cardiac silhouette", "done"),
        ("Point out any free fluid", "open"),
        ('"thought💭" x\n"action🔧" []', "cut"),
        ('"thought💭" x\n"action🔧" []\n"value✅" yes', "done"),
        ('"thought💭" x\n"action🔧" []\n"value✅" ', "empty"),
        ('"thought💭" x\n"action🔧" []\n"value✅', "cut"),
        ("没有发现骨折，建议9天后复查。", "done"),
        ("x" * 100_000 + ".", "done"),
    ],
)
def test_endings(text, want):
    assert C.inspect(text)[0] == want


@pytest.mark.parametrize("text", ['{"a": [\n{"x": 1},\n{"y": 2}', "See the list (as agreed\nby all of the panel.", "It is **most\nlikely gout."])
def test_brackets_and_marks_of_earlier_lines(text):
    assert C.inspect(text)[0] == "cut"
    assert C.inspect('{"a": [\n{"x": 1},\n{"y": 2}\n]}')[0] == C.inspect("See (as agreed\nby all).\nIt is **most\nlikely** gout.")[0] == "done"


def test_lengths():
    assert C.lengths('a&b"\n') == (5, 5, 5, 14, 7, 7, 6)
    n, utf8, utf16, *_ , ascii_, crlf = C.lengths("é🧪")
    assert (n, utf8, utf16, ascii_, crlf) == (2, 6, 3, 2 + 10 + 6, 2)


def test_lengths_as_expression(spark):
    texts = ["", 'a&b"\n', "é🧪 ab\\c", "<b>\r\n\t'x'", "没有🫁🫁", "plain"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.length_columns(F.col("t")).alias("n")).collect()
    assert {r["t"]: tuple(r["n"]) for r in got} == {t: C.lengths(t) for t in texts}


CASES = "case_id long, source_dataset string, example_reasoning map<string,string>, question string, model_answer string, state string"
EXAMPLES = "example_id long, source_dataset string, messages array<struct<role:string,content:string>>"


def test_hidden_limits_and_open_endings(spark):
    full = [(i, "A", {"Moderator": "Words of any kind stand here" + " and more" * (i % 40) + "."}, None, None, "") for i in range(400)]
    cut = [(1000 + i, "A", {"Moderator": (f"Of case {i} there is" + " much to say on this matter, which" * 9)[:200]}, None, None, "") for i in range(30)]
    cases = spark.createDataFrame(full + cut + cut[:3] + [(5000, None, None, None, None, ""), (5001, "A", {"Moderator": None}, None, None, ""), (None, "A", {"Moderator": "Cut he"}, None, None, "")], CASES)
    ask = [(i, "A", [("user", "Point out any fracture"), ("assistant", "There is no fracture."), ("user", "Point ou" if i < 2 else "Go on"), ("assistant", None)]) for i in range(50)]
    ex = spark.createDataFrame(ask + [(9, "A", None), (10, "A", [])], EXAMPLES)
    vals = C.values(cases, ex)
    looked = C.value_rows(C.looked_at(vals))
    assert [(r["source"], r["variant"], r["length"], r["values"]) for r in C.exposed_lengths(looked).where("tab = 'demo_case'").collect()] == [("a", "chars", 200, 31)]
    assert [(r["source"], r["variant"], r["length"], r["cuts"]) for r in C.hidden_limits(looked).where("tab = 'demo_case'").collect()] == [("a", "chars", 200, 30)]
    v = C.verdicts(vals)
    got = {(r["tab"], r["rec_id"], r["msg_no"]) for r in C.cut_values(v).collect()}
    assert got == {("demo_case", 1000 + i, -1) for i in range(30)} | {("data_example", i, 2) for i in range(2)}
    rates = {r["tab"]: (r["values"], r["cut"]) for r in C.cut_rates(v).collect()}
    assert rates == {"demo_case": (430, 30), "data_example": (150, 2)}
    assert C.verdicts(C.values(cases.where("false"), ex.where("false"))).count() == 0


def test_endings_without_a_full_stop_are_reviewed(spark):
    say = "The patient was seen again in the clinic. "
    whole = ["Final answer: septic arthritis", "the cardiac silhouette is normal", "\n- gout\n- heart failure", "so far so good. — agreed by all"]
    rows = [(i, "A", {"Moderator": say + whole[i % 4] if i % 4 != 1 else whole[1]}, None, None, "") for i in range(400)]
    cut = [say + "Final answer: septic arthr", "the cardiac silh", "the cardiac", say + "\n- gout\n- heart", say + "so far so good. — agr"]
    rows += [(1000 + i, "A", {"Moderator": t}, None, None, "") for i, t in enumerate(cut)]
    # a length that holds far more unpunctuated endings than its neighbours cuts at known words too, whatever the source's spelling
    rows += [(2000 + i, ("B", "b ", "B v1.0")[i % 3], {"Moderator": f"{i:02d}" + "x" * 90 + " " + w + ". " + "[ANSWER] " + "no"}, None, None, "") for i, w in enumerate(["ab"] * 12)]
    rows += [(3000 + i, ("B", "b ", "B v1.0")[i % 3], {"Moderator": (f"{i:02d} " + say * 9)[:108]}, None, None, "") for i in range(12)]
    got = {r["rec_id"] for r in C.cut_values(C.verdicts(C.values(spark.createDataFrame(rows, CASES), spark.createDataFrame([], EXAMPLES)))).collect()}
    assert len("x" * 92 + " ab. [ANSWER] no") == 108
    assert got == {1000 + i for i in range(5)} | {2000 + i for i in range(12)} | {3000 + i for i in range(12)}


Q = "Which drug most probably caused the stable focal consolidation in the left upper lobe of this patient?"


@pytest.mark.parametrize(
    "answer, prompt, want",
    [
        (None, Q, "empty"),
        ('""', Q, "empty"),
        ("It was the third drug.", Q, ""),
        ("It was the third drug, which is known to", Q, "truncated"),
        ("I cannot see a fracture, so the answer is no.", Q, ""),
        ("Sorry to say, the appearances are abnormal.", Q, ""),
        ("The patient declined surgery, so rest is best.", Q, ""),
        ("I'm sorry, but I cannot answer questions about patients.", Q, "refusal"),
        ("It is against policy to respond to clinical questions.", Q, "refusal"),
        ("Je suis désolé, mais je ne peux pas répondre à cette question.", Q, "refusal"),
        (Q, Q, "copy"),
        (Q.upper(), Q, "copy"),
        ("The question is: " + Q, Q, "copy"),
        (Q + " " + Q, Q, "copy"),
        ("Nein, es gibt bei dieser Patientin keinen Hinweis auf eine Embolie.", Q, "other_language"),
        ("没有发现骨折，建议9天后复查。", Q, "other_language"),
        ("Frage: 病变在哪里？病变在哪里？", "病变在哪里？", "copy"),
        ("Das kann ich leider nicht beurteilen.", Q, "refusal"),
        ("No estoy autorizado a responder.", Q, "refusal"),
        ("cystic lesion", "Auf der Aufnahme, welche Ursache ist am wahrscheinlichsten?", ""),
        ("D-dimer 6.3 mmol/l", Q, ""),
        ('"thought💭" x\n"action🔧" []', Q, "truncated"),
        ('"thought💭" x\n"action🔧" []\n"value✅" ', Q, "empty"),
        ("yes", None, ""),
    ],
)
def test_judge(answer, prompt, want):
    assert P.judge(answer, prompt, prompt) == want


@pytest.mark.parametrize("size", [100, 399, 401, 2_000, 100_000])
@pytest.mark.parametrize("end, want", [("a fracture.", "done"), ("a frac", "cut"), ("a fracture...", "cut"), ("good.\n- gout", "done"), ("good. **Verdict: maybe**", "done"), ("good. Answer:", "cut"), ("good. — agreed by all", "done"), ("good. Yes", "cut"), ("seen, e.g.", "cut")])
def test_an_ending_counts_the_same_at_any_length(size, end, want):
    assert C.inspect("The lungs are clear. " * (size // 21) + LONG + end)[0] == want
    assert C.inspect("no stop " * (size // 8) + end)[0] == want
    assert C._last_word("x " + "y" * size) == "y" * size and C.sentence_ends("a " + "y" * size + ". B")[0] == ["y" * size]


@pytest.mark.parametrize("n", [3, 8, 15, 16, 60, 700])
def test_a_copy_is_one_at_any_length(n):
    q = " ".join(f"word{i * 37 % 101}" for i in range(n)) + "?"
    near = " ".join(f"word{i * 37 % 101}" if i % 9 != 4 or n < 15 else "other" for i in range(n))
    assert P.is_copy(q, q) and P.is_copy("Question: " + q, q) and P.is_copy(near, q) and P.is_copy(near + " " + near, q)
    assert not P.is_copy(" ".join(f"sense{i * 37 % 101}" for i in range(n)), q)


@pytest.mark.parametrize("prompt", ["", "a b", "x\n\nWhat: is it: the cause?", "Q: one\ntwo three", "<image>\nTell me: now", "病变：在哪里\n哪里: 这 a"])
def test_question_words(prompt):
    assert [w for w in P.question_words(prompt) if w] == [P.words(q) for q in P.questions(prompt)]


def test_zstandard_savings():
    assert P.saved(Q + Q, Q) > 0.5 > P.saved("Treatment was begun at 5 mg and stopped after nine days of fever and rash.", Q)


def test_pairs(spark):
    cases = spark.createDataFrame([(1, "A", None, Q, None, ""), (1, "A", None, Q, None, ""), (2, "A", None, Q, "Fine, it was the third drug.", ""), (None, "A", None, Q, None, ""), (3, None, None, None, None, "")], CASES)
    ex = spark.createDataFrame([(1, "A", [("assistant", None), ("user", Q), ("assistant", Q), ("user", None)]), (2, None, None)], EXAMPLES)
    got = sorted(tuple(r) for r in P.defects(P.pairs_and_values(cases, ex)).collect())
    assert got == [("data_example", 1, 2, "copy"), ("demo_case", 1, -1, "empty"), ("demo_case", 3, -1, "empty")]
    assert P.defects(P.pairs_and_values(cases.where("false"), ex.where("false"))).count() == 0


def test_endings_of_pairs_are_settled_as_values_are(spark):
    # "Gout" never ends a response; prompts and the Moderator's texts show that values end in it, after any terminator
    cases = spark.createDataFrame([(i, "A", {"Moderator": "We all think of gout! It is likely."}, Q, "It is likely.", "") for i in range(30)], CASES)
    ex = spark.createDataFrame([(i, "A", [("user", "Name the cause"), ("assistant", "It is gou" if i == 1 else "Severe gout")]) for i in range(3)] + [(9 + i, "A", [("user", "Severe gout")]) for i in range(30)], EXAMPLES)
    vals = C.all_values(cases, ex)
    cut = {(r["tab"], r["rec_id"], r["msg_no"]) for r in C.cut_values(C.verdicts(vals)).collect()}
    got = {tuple(r) for r in P.defects(P.pairs_and_values(cases, ex)).collect()}
    assert got == {("data_example", 1, 1, "truncated")}
    assert {r[:3] for r in got} == {r for r in cut if r[2] == 1}
    assert C.sentence_ends("Is it gout! Yes (at last?) Not at\nall.\nNo。然后 x")[0] == ["gout", "last", "all", "no"]


CLEAN = ["Les effets indésirables, plutôt légers, ont touché l’équipe à Orléans.", "Größere Übungen wären möglich für ältere Ärzte.", "La lesión mide 3 mm y el niño está aquí; ¿cuál será?", "NÃO HÁ LESÃO ÓSSEA; A OBSERVAÇÃO", "L’ÉTÉ… “CAFÉ” à 5 °C — naïve ≥ 3", "专家组认为该病变为良性，无需手术。结果一致。"]


def wrong(text, page):
    return "".join(bytes([b]).decode(page) if b < 128 or ok(b, page) else chr(b) for b in text.encode())


def ok(b, page):
    try:
        bytes([b]).decode(page)
        return True
    except UnicodeDecodeError:
        return False


def test_key_is_learned_and_texts_are_restored(spark):
    rows, want = [], {}
    for n in range(30):
        for k, t in enumerate(CLEAN):
            rows.append((n * 1000 + k, t, "s", 1))
    no = 100_000
    for page in ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman"):
        for t in CLEAN[:3]:
            rows.append((no, wrong(t, page), "s", 1))
            want[no] = t
            no += 1
    for t in CLEAN[:3]:
        rows.append((no, wrong(wrong(t, "cp1252"), "cp1252"), "s", 1))
        want[no] = t
        no += 1
    rows.append((no, CLEAN[5].encode("gbk").decode("latin-1"), "s", 1))
    want[no] = CLEAN[5]
    no += 1
    lost = no
    rows += [(lost, CLEAN[0].encode("latin-1", "replace").decode("utf-8", "replace"), None, 1), (lost + 1, None, "s", 1), (lost + 2, "", "s", 1), (None, "Ã©", "s", 1)]
    docs = spark.createDataFrame(rows + rows[-6:], "doc_id long, text string, source string, unit int")
    assert {r["doc_id"] for r in B.garbled(docs).collect()} == {*want, lost}
    got = {r["doc_id"]: (r["restored"], r["complete"]) for r in B.restore(docs).collect()}
    assert got.pop(lost)[1] is False
    assert {k: v[0] for k, v in got.items()} == want
    assert B.garbled(docs.where("false")).count() == 0


WORDS = "Les médecins ont noté une lésion régulière, étendue et bénigne; l'état général était préservé après la première opération, très légère. La santé du bébé née à Orléans est excellente."


def french(spark, extra):
    rows = [(n, " ".join(w for k, w in enumerate(WORDS.split()) if (n >> k % 7) % 3 or k % 5), "s") for n in range(200)]
    return spark.createDataFrame(rows + extra, "doc_id long, text string, source string")


@pytest.mark.parametrize("page", ["cp1253", "cp1256", "cp852", "mac_greek", "hp_roman8"])
def test_pages_of_no_list(spark, page):
    extra = [(900, wrong(WORDS, page), "s")]
    assert {(r["doc_id"], r["restored"]) for r in B.restore(french(spark, extra)).collect()} == {(900, WORDS)}


@pytest.mark.parametrize("page", ["mac_roman", "cp850", "cp437", "cp1253", "cp1251", "koi8_r"])
def test_letters_swapped_for_letters_at_word_edges_too(spark, page):
    """santé, état, née: one byte read with another page, in a source in which most texts are genuine."""
    extra = [(900, WORDS.encode("cp1252").decode(page), "s"), (901, WORDS + " " + WORDS.encode("cp1252").decode(page), "s")]
    got = {r["doc_id"]: r["restored"] for r in B.restore(french(spark, extra)).collect()}
    assert got.keys() == {900, 901} and got[900] == WORDS


def test_a_cipher_without_a_page_is_learned(spark):
    cipher = str.maketrans({"é": "∆", "è": "∑"})
    extra = [(900 + n, " ".join(WORDS.split()[n % 9 :]).translate(cipher), "other") for n in range(40)]
    key = {r["unit"]: (r["letter"], r["key"]) for r in B.learn(B.prepared(french(spark, extra))).where("source = 'other'").collect()}
    assert key["∆"] == ("é", "free")
    assert {r["doc_id"] for r in B.garbled(french(spark, extra)).collect()} == {x[0] for x in extra}


def test_genuine_signs_stay(spark):
    signs = ["5 µm² ± 3 °C — 10 × 2 ½ € 🫁🧪 Ω", "Это обычный русский текст без ошибок.", "Η εξέταση ήταν φυσιολογική.", "CAFÉ À L’ÉTÉ", "naïve Ångström Dvořák São Łódź"]
    assert B.garbled(french(spark, [(900 + i, t, "s") for i, t in enumerate(signs * 5)])).count() == 0
