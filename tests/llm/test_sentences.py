"""Sentence units on literal texts of all languages, and invariants."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textmill.llm import queries
from textmill.llm import sentences as sn
from textmill.llm.sentences import DICTIONARY, dictionary, segment, sentence_units

# units are separated by a bar; blanks around it belong to the text
TEXTS = [
    "Dr. Tamsk saw it.| It ended at 1.5.| Nothing else!",
    "We used approx. 5 min. and ca. 3 GB, e.g. those of a.| See Fig. 3, Sec. 10.4, for more.| T. Drossel left.",
    "The U.K. mirror lags by 8 hrs. on most days.| It shipped at 9 p.m. on Monday.| We tuned the rate, the size, etc.| The end.",
    'The step time was 1.2... then it fell.| "Looks fine." was all that Orvell noted.| As Dr. Varn put it: "Stop the run."| Nobody answered...| He left.',
    '"Why now?" asked Ilvane.| Drossel wrote "Restart it!" in the margin, then left.| The log says "step 1 of 9... killed" and nothing else.',
    "(See Fig. 16 for the score.)| It is a trade (see No. 22) after all.| v1.8.5 was cut.| See docs.a.example/ckpt_best.pt now.",
    "It failed on hollowpress.|The pass rate fell.| It ended at 4.7.| eager-dune-314 was promoted.| lr was 1e-3.| eval.py reads it.",
    "What remains: the rest; we wait.| Really?| Yes!",
    "Der 16. Versuch ergab 3,9.| Am 3. Mai lief es.| Wir prüften Rate, Puffer usw.| Siehe Nr. 28, S. 513.| Er lief z. B. auf 4, d. h. um 2 Prozent.",
    "„Der Lauf steht. Wir brechen ab“, schrieb Varn.| „Warum jetzt?“, fragte N. Varn.| Dr. Heskov hat bzgl. a den Puffer geleert, vgl. Abb. 9.",
    "« La courbe monte. On arrête », écrit Ilvane.| Mme Varn note : « Ne touchez à rien. »| Le débit passe de 1 à 2, c.-à-d. 22 pour cent.| Voir a.log, n° 27, art. 11.| Pourquoi ?| Oui !",
    "«¿Por qué ahora?», preguntó G. Brinlow.| ¿por qué se detuvo?| El Sr. Ekkary usó a.log, núm. 21.| Pesa aprox. 2 GB en EE. UU. y 3 MB aquí.| Pasó de 4 a 0, p. ej. en a.",
    "Проверили шаг, зерно и т. д.| Перплексия упала до 3, т. е. на 4.| «Кривая растёт. Останавливаем», — написал дежурный.| Файл лежит в разд. 11.15.| Версия весит ок. 21 ГБ, напр. для a.",
    "我们检查了学习率、种子……结果停了。|“曲线在上升。先停下来。”值班员写道。|他写道：“重启a。”|因为停了，所以走了！|为什么？",
    "「なぜ今なのか？」と査読者は尋ねた。|学習率、種…を調べたが、止まった。|公開の前に下げた！|なぜ？",
    "कुछ हुआ।| क्या रुका?| डॉ. Gothrel ने देखा।| \"वक्र बढ़ रहा है। अभी रोको,\" प्रमुख ने लिखा।",
    "डॉ. Mirrin ने तुलना की.| ferrydocs के 3 नमूने छाँट दिए गए.| हुआ.",
    'ارتفع المنحنى.| لماذا توقف؟| قال د. سامر إن الملف تالف.| كتب المناوب: "المنحنى يرتفع. أوقفوا العمل."| راجع الإصدار v1.5.0؛ فهو أحدث.',
    "อัตราผ่านเพิ่มจาก 3.72 เป็น 2.7 ในหนึ่งสัปดาห์| ข้อมูลชุด windrow-news ถูกกรองซ้ำ| ไฟล์ a.pkl รุ่น v1 ใหญ่",
    "# Setup vs. baseline\n|- check tokens.idx, esp. the last. Rows\n|- two. three.\n|1. one. Two.\n|2. two\n\n|Plain text. |Then more.",
    "Step 3. Cleaning\n\n|It is a line\nthat goes on.| And ends.\n\n|```python\nx = 1.\n\nprint('a. B')\n```\n|After it.",
    "第一行\n|第二行\n|第三行。",
]


def parts(marked):
    text, cuts = "", []
    for p in marked.split("|"):
        text += p
        cuts.append(p.strip())
    return text, [c for c in cuts if c]


@pytest.mark.parametrize("marked", TEXTS)
def test_units(marked):
    text, want = parts(marked)
    assert [text[s:e] for s, e in segment(text)] == want


@pytest.mark.parametrize("ends", ["\r\n", "\r"])
def test_line_ends(ends):
    text = f"One line{ends}goes on. Two.{ends}{ends}- a{ends}- b"
    assert [text[s:e] for s, e in segment(text)] == [f"One line{ends}goes on.", "Two.", "- a", "- b"]


def covers(text):
    units = segment(text)
    seen = [False] * len(text)
    for s, e in units:
        assert s < e and not text[s].isspace() and not text[e - 1].isspace()
        for k in range(s, e):
            assert not seen[k]
            seen[k] = True
    assert all(seen[k] or c.isspace() for k, c in enumerate(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab AB.!?…\"“”„«»「」()[]（） \n\r\t-#`1。？！،؟।กข中あ:;,'\x85 ", max_size=80))
def test_every_character_is_in_one_unit(text):
    covers(text)


@pytest.mark.parametrize("text", ["", " \n", None, ".", "...", "\"", "(", "```", "a" * 50_000, "a. " * 20_000, "(" * 5000, "。" * 5000, "```\nopen"])
def test_odd_texts(text):
    if text is None or not text.strip():
        assert segment(text) == []
    else:
        covers(text)


def test_word_path():
    words = dictionary(DICTIONARY)
    assert words.path("因为停了")[0] == "因为" and "".join(words.path("種を調べた")) == "種を調べた"
    assert words.path("问题在这里")[0] == "问题" and words.path("他问")[-1] == "问"
    assert "".join(words.path("曲" * 3000)) == "曲" * 3000
    with pytest.raises(FileNotFoundError):
        dictionary("/nowhere")


#: Gaps that only the words around them decide.
WORDS = [
    "“为什么停了？”他问。|问题在缓存里。", "“为什么停了？”|问题在缓存里。", "他说：“停下来。”|我们走了。", "“已经停了！”组长喊道，然后离开。", "“好。”|那时天黑了。",
    "「止めよう。」という声が出た。|彼は去った。", "「止めよう。」|しかし誰も止めなかった。", "本当？と思った。", "疲れた…|でも続けた。", "学習率、種…を調べた。", "我们检查了……的记录。", "太晚了……|但是没有人走。",
]


@pytest.mark.parametrize("marked", WORDS)
def test_words_decide(marked):
    text, want = parts(marked)
    assert [text[s:e] for s, e in segment(text)] == want


#: Text whose cuts can't be told mark by mark.
SPANS = [
    "„Der Lauf steht. Wir brechen ab“, schrieb Varn.| Er ging.", 'He said "Stop it. Go home. It is late." and left.| Then it rained.', "(It ended. Nobody cared.)| The log (see Nr. 2. and 3.) is gone.", '"Stop it. Go home."| He left.| It rained.', 'He left. "Stop it," she said.'.replace("left. ", "left.| "),
    "It rained... (Nobody cared.)| She left.".replace("... (", "...| ("), 'An open "quotation. It never ends.| So be it.'.replace("quotation. ", "quotation.| "),
]


@pytest.mark.parametrize("marked", SPANS)
def test_spans_decide(marked):
    text, want = parts(marked)
    assert [text[s:e] for s, e in segment(text)] == want


def _right(texts):
    got = 0
    for marked in texts:
        text, want = parts(marked)
        got += len(set(want) & {text[s:e] for s, e in segment(text)})
    return got


def test_both_lattices_matter(monkeypatch):
    spans, words = _right(TEXTS + SPANS), _right(TEXTS + WORDS)
    with monkeypatch.context() as m:
        m.setattr(sn, "_best_path", lambda t, s, e, nodes: [n[0] for n in nodes if n[1] > 0])
        assert _right(TEXTS + SPANS) <= spans - 15
    with monkeypatch.context() as m:
        m.setattr(sn, "_spaceless_gap", lambda t, s, i, k, e, words, prior, told=False: prior)
        assert _right(TEXTS + WORDS) <= words - 8
    with monkeypatch.context() as m:  # letters in place of words
        m.setattr(sn.Words, "path", lambda self, run: list(run))
        letters = _right(WORDS)
    assert letters < _right(WORDS)


def test_table(spark):
    df = spark.createDataFrame([(1, "One. Two."), (2, None), (3, " "), (None, "x"), (1, "One. Two.")], "doc_id long, text string").selectExpr("*", "0 as id")
    got = sorted(map(tuple, sentence_units(df).collect()), key=str)
    assert got == sorted([(1, 0, 4), (1, 5, 9)] * 2 + [(None, 0, 1)], key=str)
    assert sentence_units(df.limit(0)).count() == 0
    named = spark.createDataFrame([("a", "Hi.")], "k string, t string")
    assert [tuple(r) for r in sentence_units(named, "k", "t").collect()] == [("a", 0, 3)]


def test_query_covers_whole_texts(spark, tiny):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = {}
    for r in queries.p6_found(spark, tiny).collect():
        got.setdefault(r["doc_id"], []).append((r["char_start"], r["char_end"]))
    for i, t in docs.items():
        held = sum(e - s for s, e in got.get(i, []))
        assert held >= sum(not c.isspace() for c in t or "")
