"""Defects on literal answers, and invariants over a real table."""

import pytest

from tests.llm.refusal_cases import ANSWERS, REFUSALS
from textmill.llm import languages as lg
from textmill.llm import pairs as pr
from textmill.llm import queries
from textmill.llm.refusals import is_refusal

Q = "How do I lower the step time of young-vole-12?"
CASES = [
    (Q, None, "empty"), (Q, "", "empty"), (Q, " \n\t", "empty"), (Q, "...", "empty"), (Q, "N/A", "empty"), (Q, "<answer></answer>", "empty"), (Q, "```\n```", "empty"), (Q, "Assistant:", "empty"), (Q, "​​", "empty"), (Q, "[no answer]", "empty"), (Q, "🙂", "empty"),
    (Q, "No.", None), (Q, "42", None), (Q, "B", None), (Q, "Yes", None), (Q, "step 31", None), (Q, "1e-5", None), (Q, "Halve the batch size.", None),
    (Q, Q, "copied_prompt"), (Q, Q.upper(), "copied_prompt"), (Q, f'"{Q}"', "copied_prompt"), (Q, "how  do i lower the step time of young-vole-12", "copied_prompt"), (Q, f"{Q} {Q}", "copied_prompt"), (Q, f"Question: {Q}", "copied_prompt"), (Q, "How do I lower the time of young-vole-12?", "copied_prompt"),
    (Q, f'You ask: "{Q}" Halve the batch size, then restart the run.', None),
    ("word " * 90 + "and so on, what now?", 'You ask: "' + "word " * 90 + 'and so on, what now?" Halve the batch size.', None),
    (Q, "I'm sorry, but I can't help with that.", "refusal"), (Q, "i cant answer that", "refusal"), (Q, "I must decline to comment on young-vole-12. Is there anything else you would like to know?", "refusal"),
    (Q, "Sorry for the late reply. Halve the batch size.", None), (Q, "I can't reproduce the stall here, but the fix is known: halve the batch size.", None),
    ("Was tun, wenn die Platte voll war?", "Das kann ich leider nicht beantworten.", "refusal"), ("为什么停了？", "抱歉，我无法回答这个问题。", "refusal"), ("なぜ止まったのか？", "申し訳ありませんが、お答えできません。", "refusal"),
    (Q, "Das Gleitfenster lief wieder, weil wir die Rate gesenkt haben und der Puffer leer war.", "other_language"), (Q, "因为每个块有填充，所以我们把学习率降了。", "other_language"), ("Translate into German: the loss went flat.", "Der Verlust ist danach nicht mehr gefallen.", None), ("Translate into German: the loss went flat.", "La perte a cessé de baisser après le pas.", "other_language"),
    (Q, "After we removed the noisy shards, the", "truncated"), (Q, "We halved it, cf. Fig.", "truncated"), (Q, '{"run": "a", "steps": [1,', "truncated"), (Q, '{"run": "a", "steps": [1, 2]}', None), (Q, "Use this:\n```python\nfor k in range(3):\n    restart", "truncated"), (Q, "Use this:\n```python\nx = 1\n```", None), (Q, "Do this:\n1. stop the job\n2. restart\n3.", "truncated"), (Q, "Do this:\n- stop the job\n- start the job", None),
    (Q, "And then nothing moved for 12 steps…", None), (Q, "Nobody answered...", None), (Q, "It shipped at 9 p.m.", None), (Q, "因为没有人记录随机种子，所以我们", "other_language"), ("为什么停了？", "因为没有人记录随机种子，所以我们", "truncated"), (None, "Fine.", None),
]


#: Complete answers that use the words of their question.
RESTATED = [
    ("What is the name of the largest planet in our solar system?", "The name of the largest planet in our solar system is Jupiter."),
    ("Who wrote the novel Pride and Prejudice in the year 1813?", "Jane Austen wrote the novel Pride and Prejudice in the year 1813."),
    ("Is the learning rate of the run set to the default value?", "The learning rate of the run is set to the default value."),
    ("Which optimiser did the second run of the sweep use?", "The second run of the sweep did use AdamW."),
    ("How many layers does the small model of the sweep have?", "The small model of the sweep does have 12 layers."),
    ("Was the checkpoint of step 300 written to the shared disk?", "The checkpoint of step 300 was written to the shared disk."),
    ("Does the length filter drop the short samples of the corpus?", "The length filter does drop the short samples of the corpus."),
    ("Did the loss of the run rise after the restart?", "No, the loss of the run did not rise after the restart."),
    ("When did the run of the larger model end?", "The run of the larger model did end yesterday."),
    ("Why did the loss of the run spike at step 12?", "The loss of the run did spike at step 12 because the seed changed."),
    ("Where is the config of the baseline stored?", "The config of the baseline is stored in experiments."),
    ("Can I restart the sweep from the last checkpoint?", "I can restart the sweep from the last checkpoint."),
    ("Ist die Lernrate des Laufs auf den Standardwert gesetzt?", "Die Lernrate des Laufs ist auf den Standardwert gesetzt."),
    ("Wie heißt der größte Planet in unserem Sonnensystem?", "Der größte Planet in unserem Sonnensystem heißt Jupiter."),
    ("Wer schrieb den Roman im Jahr 1813?", "Den Roman schrieb im Jahr 1813 Jane Austen."),
    ("Est-ce que la perte du modèle baisse après le pas 12 ?", "La perte du modèle baisse après le pas 12."),
    ("Quel est le plus grand port de la région ?", "Le plus grand port de la région est Marseille."),
    ("¿Cuál es la capital de la región más grande?", "La capital de la región más grande es Toledo."),
    ("¿Está el modelo grande en el disco compartido?", "El modelo grande está en el disco compartido."),
    ("Остановился ли запуск после шага 12 на первом узле?", "Запуск остановился после шага 12 на первом узле."),
    ("学习率3e-4适合这个模型吗？", "学习率3e-4适合这个模型。"),
    ("这个模型的学习率是多少？", "这个模型的学习率是3e-4。"),
    ("この学習率はモデルに合いますか？", "この学習率はモデルに合います。"),
]
#: Prompts and answers in languages with and without a profile: (prompt, answer, are they different).
LANGUAGES = [
    ("Come posso abbassare il tempo di ogni passo del modello?", "The loss went flat because the learning rate was too low.", True),
    ("Hoe kan ik de tijd van elke stap van het model verlagen?", "The loss went flat because the learning rate was too low.", True),
    ("Jak mogę skrócić czas każdego kroku tego modelu?", "The loss went flat because the learning rate was too low.", True),
    ("What should I check first when the node ran out of disk?", "O modelo não convergiu porque a taxa de aprendizado era muito alta.", True),
    ("Come posso abbassare il tempo di ogni passo del modello?", "La perdita si ferma perché il tasso di apprendimento è troppo basso.", False),
    ("Hoe kan ik de tijd van elke stap van het model verlagen?", "Het verlies blijft gelijk omdat de leersnelheid te laag is.", False),
    ("Jak mogę skrócić czas każdego kroku tego modelu?", "Strata stoi w miejscu, ponieważ tempo uczenia jest za małe.", False),
    ("Como posso reduzir o tempo de cada passo do modelo?", "O modelo não convergiu porque a taxa de aprendizado era muito alta.", False),
    ("Who wrote Hamlet?", "It was written by William Shakespeare around the year 1600.", False),
    ("Name three rivers of Europe.", "The Danube, the Rhine and the Elbe are long rivers there.", False),
    ("Nenne drei Flüsse in Europa.", "Die Donau, der Rhein und die Elbe sind lange Flüsse dort.", False),
    ("Cite trois fleuves de l'Europe.", "Le Danube, le Rhin et l'Elbe sont de longs fleuves de la région.", False),
    ("Nombra tres ríos de Europa.", "El Danubio, el Rin y el Elba son los ríos más largos de la zona.", False),
    ("Nenne drei Flüsse in Europa und sage, wo sie in das Meer münden.", "Le Danube, le Rhin et l'Elbe sont de longs fleuves de la région.", True),
    # too few words to be sure of
    ("Nenne drei Flüsse in Europa.", "Le Danube, le Rhin et l'Elbe sont de longs fleuves de la région.", False),
    ("What should I check first when the node ran out of disk?", "データの混合を見直してください。", True),
    ("What should I check first when the node ran out of disk?", "ckpt_best.pt", False),
]


@pytest.fixture(scope="module")
def profiles(spark):
    return lg.fit_profiles(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


@pytest.mark.parametrize("prompt,answer,want", CASES)
def test_defect(profiles, prompt, answer, want):
    assert pr.defect(prompt, answer, profiles) == want


@pytest.mark.parametrize("prompt,answer", RESTATED)
def test_a_restated_question_is_an_answer(profiles, prompt, answer):
    assert pr.defect(prompt, answer, profiles) is None
    assert pr.defect(prompt, prompt, profiles) == "copied_prompt"


@pytest.mark.parametrize("prompt,answer,want", LANGUAGES)
def test_languages(profiles, prompt, answer, want):
    assert (pr.defect(prompt, answer, profiles) == "other_language") is want


def test_profiles_of_labelled_texts(spark, profiles):
    """Held-out documents: those not in the sample, whose label is right."""
    assert {"de", "en", "es", "fr"} <= set(profiles.langs)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('de', 'en', 'es', 'fr') and length(text) > 40").select("lang", "text").collect()
    read = [(r["lang"], lg.Reading(r["text"], profiles).lang) for r in docs]
    assert sum(a == b for a, b in read) >= 0.95 * len(read)
    empty = lg.fit_profiles(spark.createDataFrame([(None, None)], "lang string, text string"))
    assert empty.langs == [] and pr.defect(Q, "Le modèle a repris après le pas suivant.", empty) is None


@pytest.mark.parametrize("text", REFUSALS)
def test_refusals(text):
    assert is_refusal(text)


@pytest.mark.parametrize("text", ANSWERS)
def test_answers_that_look_like_refusals(text):
    assert not is_refusal(text)


def test_no_length_hides_a_defect(profiles):
    no = "I'm sorry, but I can't help with that. "
    assert pr.defect(Q, no * 400, profiles) == "refusal"
    assert pr.defect(Q, no * 400 + "The loss is 2.3.", profiles) is None
    assert pr.defect(Q, " ".join([Q] * 400), profiles) == "copied_prompt"
    assert pr.defect(Q, " ".join([Q] * 400) + " Halve the batch size, then lower the rate and restart the run." * 100, profiles) is None
    assert pr.defect("b a " * 30_000, "b a " * 30_000, profiles) == "copied_prompt"


def test_a_cut_word_in_a_list(profiles):
    text = "Do this:\n- stop the job\n- restart fro"
    assert pr.defect(Q, text, profiles) == "truncated" and pr.defect(Q, text + "m step", profiles) is None


def test_subsequence():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    import random

    r = random.Random(1)
    for _ in range(200):
        a, b = [r.choice("abcd") for _ in range(r.randrange(15))], [r.choice("abcd") for _ in range(r.randrange(15))]
        assert pr.common_subsequence(a, b) == plain(a, b)


def test_table_edges(spark, profiles):
    rows = [(1, Q, None, "Fine."), (1, Q, None, "Fine."), (2, None, "", None), (None, Q, Q, "word " * 20_000 + ".")]
    df = spark.createDataFrame(rows, "pair_id long, prompt string, chosen string, rejected string").selectExpr("*", "'x' as side", "'y' as answer")
    got = sorted(map(tuple, pr.pair_defects(df, profiles).collect()), key=str)
    assert got == sorted([(1, "chosen", "empty"), (2, "chosen", "empty"), (2, "rejected", "empty"), (None, "chosen", "copied_prompt")], key=str)
    assert pr.pair_defects(df.limit(0)).count() == 0 and pr.pair_defects(df).count() == 4


def test_query(spark, tiny):
    rows = queries.p3_found(spark, tiny).collect()
    assert rows and len({(r["pair_id"], r["side"]) for r in rows}) == len(rows)
    assert {r["defect"] for r in rows} <= {"empty", "truncated", "refusal", "copied_prompt", "other_language"}
