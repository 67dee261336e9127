"""Defects of preference pairs: empty, copied, refused, foreign or broken-off answers.

An answer is compared with its prompt on tokens (words; letters where a script
has no blanks): shingle containment picks what can be a copy, and the longest
common subsequence decides it, so that changed case, marks, blanks, a left-out
word or a repetition don't hide one. A word that the prompt lacks, or a question
turned into a statement, makes it an answer. Refusals are aligned with slot
templates (``refusals``), languages compared by profiles of a bounded labelled
sample (``languages``), and what breaks off is seen from its open structures and
its last words.

The verdict on a side depends on the pair alone, whatever else the table holds.
The work is one narrow stage; only the small result is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.languages import QUOTED, Profiles, Reading, differ, is_not
from textmill.llm.refusals import is_refusal
from textmill.llm.sentences import MAY_END, RUNS_ON
from textmill.llm.words import WORD
from textmill.runtime import spread

#: A long answer is compared with its prompt in stretches of so many prompts.
STRETCH = 16

# Fixed values.
#: What stands for no answer.
PLACEHOLDERS = frozenset("na null none nil nan undefined tbd todo empty blank leer vide vacío пусто 无 なし".split()) | {
    "n a", "no answer", "no response", "no output", "not available", "not applicable", "keine antwort", "aucune réponse", "pas de réponse", "sin respuesta", "нет ответа", "无回答", "回答なし",
}
#: Labels of a turn, in front of an answer or alone.
LABELS = ("assistant", "assistent", "answer", "response", "antwort", "réponse", "reponse", "respuesta", "asistente", "ответ", "ассистент", "助手", "回答", "答", "アシスタント", "question", "frage", "pregunta", "вопрос", "问题", "質問", "prompt", "user", "human", "q", "a", "gpt", "bot")
#: How a prompt names the language it wants its answer in.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés английск 英语 英文 英語", "de": "german deutsch allemand alemán немецк 德语 德文 ドイツ語", "fr": "french französisch français francés французск 法语 法文 フランス語", "es": "spanish spanisch espagnol español испанск 西班牙语 スペイン語",
    "ru": "russian russisch russe ruso русск 俄语 ロシア語", "zh": "chinese chinesisch chinois chino китайск 中文 汉语 中国語", "ja": "japanese japanisch japonais japonés японск 日语 日文 日本語",
}
_ASKING = re.compile(
    r"translat|\b(?:answer|reply|respond|write|say|put|explain)\b[^.?!:]{0,30}\bin\b|version of|only in|übersetz|auf \w+(?:isch|tsch)\b|antwort\w* (?:bitte )?auf|tradui|réponds|répondez|en (?:anglais|allemand|français|espagnol|russe|chinois|japonais)|traduc|traduz|responde|contesta|en (?:inglés|alemán|francés|español|ruso|chino|japonés)|перевед|ответь|ответьте|по-(?:русски|английски|немецки|французски|испански|китайски|японски)|翻译|译成|译为|用.{1,4}(?:回答|写|说)|訳|で(?:答え|回答|書い)", re.I,
)
_NAMED = [(lang, re.compile("|".join(rf"\b{w}" if w.isascii() or not re.match("[一-鿿ァ-ヶ]", w) else w for w in names.split()), re.I)) for lang, names in LANGUAGE_NAMES.items()]

_NAMES = [w for names in LANGUAGE_NAMES.values() for w in names.split()]
_TAG = re.compile(r"<\|?/?[\w\s]{1,24}\|?/?>")
_DENSE = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
_BRACKETS = re.compile(r"[()\[\]{}（）「」『』«»]")
_END = ".!?。！？…।؟｡．"
_CLOSE = "\"'”’»“」』)）]】*_`"
_ENTRY = re.compile(r"[ \t]*([-*+•]|\d{1,3}[.)])(?:[ \t]+(.*)|$)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n")
_NAME_LIKE = re.compile(r"[A-Za-z]+(?:[-_.]\w+)+|\b\w*\d\w*\b")
#: Words that can't be the last of an entry or of a short answer.
DANGLING = frozenset("the a an of to in on at by for with from and or but which that because as if than into is are was were be der die das den dem ein eine und oder mit von zu für im weil dass le la les de des du et un une à dans avec pour que el los las y en con por para un una и в на с к по для что".split())


#: Small words that may be added to a prompt without saying anything.
ADDED = frozenset("a an the of to please so ok bitte s il vous plaît por favor пожалуйста 请".split())
#: What ends a question in scripts whose questions need no other order.
QUESTION_ENDS = ("吗", "呢", "么", "か", "の")


def dense(text: str) -> bool:
    return len(_DENSE.findall(text)) * 3 >= len(WORD.findall(text)) and bool(_DENSE.search(text))


def tokens(text: str, letters: bool) -> list[str]:
    ws = WORD.findall(text.lower())
    if not letters:
        return ws
    out: list[str] = []
    for w in ws:
        out += list(w) if _DENSE.search(w) else [w]
    return out


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, on bit sets."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for y in b:
        m = rows & where.get(y, 0)
        rows = ((rows + m) | (rows - m)) & full
    return len(a) - rows.bit_count()


def _nearly(word: str, known: frozenset[str]) -> bool:
    """A known word in another form: a letter more or less, or another ending."""
    if word in known or word in ADDED:
        return True
    if any(c.isdigit() for c in word) or len(word) < 4:
        return False
    drop = {word[:i] + word[i + 1 :] for i in range(len(word))}
    return any(
        k[:3] == word[:3] and abs(len(k) - len(word)) <= 2 and (k.startswith(word) or word.startswith(k) or k in drop or any(k[:i] + k[i + 1 :] in drop or k[:i] + k[i + 1 :] == word for i in range(len(k))))
        for k in known if len(k) >= 4 and not any(c.isdigit() for c in k)
    )


def _repeats(a: list[str], b: list[str], letters: bool) -> bool:
    """The tokens b say a once or more, and nothing else."""
    if len(b) < 2 or len(a) < 2:
        return False
    known = frozenset(a)
    strange = [w for w in b if w not in known]
    if len(strange) > len(b) // 5 or (strange and (letters and len(b) < 20 or not all(_nearly(w, known) for w in strange))):
        return False
    grams = {tuple(a[i : i + 2]) for i in range(len(a) - 1)}
    if 2 * sum((x, y) in grams for x, y in zip(b, b[1:])) < len(b) - 1:
        return False
    times = max(1, round(len(b) / len(a)))
    if len(b) <= STRETCH * len(a):
        shared = common_subsequence(a * times, b)
    else:
        # a stretch begins anywhere in the prompt, so it meets one prompt more than it is long
        step = STRETCH * len(a)
        shared = sum(common_subsequence(a * (STRETCH + 1), b[k : k + step]) for k in range(0, len(b), step))
    return shared >= 0.8 * len(b) and shared >= 0.6 * len(a) * times and len(b) <= len(a) * times + max(3, len(a) // 2)


def _states(prompt: str, answer: str, a: list[str], b: list[str]) -> bool:
    """The answer turns the question of the prompt into a statement."""
    asked, said = prompt.rstrip(_CLOSE + " \n"), answer.rstrip(_CLOSE + " \n")
    if not asked.endswith(("?", "？", "؟")) or said.endswith(("?", "？", "؟")):
        return False
    bare, mine = asked.rstrip("?？ "), said.rstrip(".。!！ ")
    if _DENSE.search(asked) and bare.endswith(QUESTION_ENDS):
        return not mine.endswith(QUESTION_ENDS)
    return len(b) <= len(a) + 1 and bool(b) and b[0] != a[0]


def _by_head(letters: bool) -> dict[str, list[list[str]]]:
    heads: dict[str, list[list[str]]] = {}
    for label in LABELS:
        said = tokens(label, letters)
        heads.setdefault(said[0], []).append(said)
    return heads


_LABELS = {letters: _by_head(letters) for letters in (False, True)}


def is_copy(asked: _Asked, answer: str) -> bool:
    """The answer only says the prompt, or what the prompt asks, again."""
    b = tokens(answer, asked.letters)
    for part, a in asked.parts:
        mine = b
        for said in _LABELS[asked.letters].get(b[0], ()) if b else ():
            if mine[: len(said)] == said and a[: len(said)] != said:
                mine = mine[len(said) :]
                break
        if _repeats(a, mine, asked.letters) and not _states(part, answer, a, mine):
            return True
    return False


def wanted_language(prompt: str) -> str | None:
    """The language that a prompt asks for by name."""
    low = prompt.lower()
    if not any(name in low for name in _NAMES):
        return None
    asked = _ASKING.search(QUOTED.sub(" ", prompt))
    if asked:
        near = prompt[max(0, asked.start() - 30) : asked.end() + 40]
        named = [(m.start(), lang) for lang, p in _NAMED if (m := p.search(near))]
        if named:
            return min(named)[1]
    return None


class _Asked:
    """A prompt with what its answers are compared with."""

    def __init__(self, prompt: str, profiles: Profiles):
        self.text, self.letters = prompt, dense(prompt)
        self.parts = [(prompt, tokens(prompt, self.letters))]
        parts = [p for p in _SENTENCE.split(prompt) if WORD.search(p)]
        if len(parts) > 1:
            for k, p in enumerate(parts):
                if k == 0 or p.rstrip().endswith(("?", "？")):
                    a = tokens(p, self.letters)
                    if len(a) >= (8 if self.letters else 5):
                        self.parts.append((p, a))
        self.named = wanted_language(prompt)
        self.reading = None if self.named else Reading(prompt, profiles)


def is_foreign(asked: _Asked, answer: str, profiles: Profiles) -> bool:
    """Not in the language that the prompt names, or else is in."""
    if asked.named is None and asked.reading.lang is None:
        return False
    if asked.text and asked.text in answer:
        answer = answer.replace(asked.text, " ")
    got = Reading(answer, profiles)
    return is_not(asked.named, got, profiles) if asked.named else differ(asked.reading, got, profiles)


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = _TAG.sub(" ", answer) if "<" in answer else answer
    bare = re.sub(r"```\w*", " ", bare) if "```" in bare else bare
    ws = [m[0] for m in islice(WORD.finditer(bare), 4)]
    if len(ws) > 3:
        return False
    ws = [w.lower() for w in ws]
    if not ws:
        return True
    if " ".join(ws) in PLACEHOLDERS and len(ws) <= 3 and not (len(ws) == 1 and len(ws[0]) == 1 and ws[0].isascii()):
        return True
    return len(ws) <= 1 and ws[0] in LABELS and len(ws[0]) > 1 and bool(re.search(r"[:：]\s*$", bare))


def list_entries(text: str | None) -> list[tuple[str, str]]:
    """(marker, entry) of the list lines of a text."""
    out = []
    for line in (text or "").splitlines():
        if m := _ENTRY.match(line):
            out.append((m[1], m[2] or ""))
    return out


def _unclosed(text: str) -> bool:
    """A bracket or quotation is still open at the end."""
    if text.count("```") % 2:
        return True
    stack: list[str] = []
    pairs = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "«": "»"}
    for c in _BRACKETS.findall(text):
        if c in pairs:
            stack.append(pairs[c])
        elif stack and stack[-1] == c:
            stack.pop()
    if stack:
        return True
    if text.count("„") > text.count("“") + text.count("”") or (not text.count("„") and text.count("“") > text.count("”")):
        return True
    return text.count('"') % 2 == 1


def is_truncated(answer: str, profiles: Profiles) -> bool:
    """The answer stops before its sentence, list entry, code or data is complete."""
    text = answer.rstrip()
    if not text:
        return False
    if _unclosed(text):
        return True
    if text.endswith("```") or (text[0] in "{[" and text[-1] in "}]"):
        return False
    lines = text.splitlines()
    last = _ENTRY.match(lines[-1])
    entries = list_entries(text)
    if last and len(lines) > 1:
        body = (last[2] or "").strip()
        if not body:
            return True
        kinds = {m if not m[0].isdigit() else "1" + m[-1] for m, _ in entries}
        if body[-1] in _END:
            return _dangling_end(body)
        last_word = (WORD.findall(body.lower()) or [""])[-1]
        if len(kinds) > 1 or body[-1] in ",:;-–(" or not last_word or last_word in DANGLING:
            return True
        return body.split()[-1] == last_word and profiles.cut_word(last_word, Reading(answer, profiles).lang)
    bare = text.rstrip(_CLOSE + " ")
    if bare[-1:] and bare[-1] in _END:
        return _dangling_end(bare)
    ws = text.split()
    if _DENSE.search(text):
        return len(_DENSE.findall(text)) > 2 or len(WORD.findall(_DENSE.sub(" ", text))) > 0
    if text[-1] in ",:;-–—、，：；(":
        return len(ws) > 1 or text[-1] in ",;，；、"
    words_ = WORD.findall(text.lower())
    if len(ws) <= 2:
        return bool(words_) and len(ws) == 2 and words_[-1] in DANGLING
    if len(ws) == 3 and all(_NAME_LIKE.fullmatch(w.strip(",")) for w in ws[1:]):
        return False
    return True


def _dangling_end(text: str) -> bool:
    """The final dot belongs to an abbreviation that needs something after it."""
    if not text.endswith(".") or text.endswith(".."):
        return False
    parts = text[:-1].split()
    if not parts:
        return False
    token = parts[-1].lstrip("\"“„«([")
    key = token.lower()
    before = parts[-2].lower() if len(parts) > 1 else ""
    if before.endswith(".") and len(key) <= 3 and (before + key) in RUNS_ON:
        return True
    if key in MAY_END or (before.endswith(".") and (before + key) in MAY_END):
        return False
    if key == "no":
        return len(parts) > 1 and not before.endswith((".", "!", "?"))
    if key in RUNS_ON and key not in ("est", "st", "al", "fr", "hr", "max", "hon", "pres", "resp", "mind", "им", "о", "ca", "ms", "col", "gen"):
        return True
    return key in ("fig", "figs", "tab", "sec", "abb", "nr", "núm", "pág", "разд", "табл", "рис", "см", "p", "n°", "vs", "cf", "est", "ca") and len(parts) > 1


def defects(prompt: str | None, answers: list[str | None], profiles: Profiles) -> list[str | None]:
    """The defect of each answer to a prompt, if it has one."""
    asked = None
    out: list[str | None] = []
    for answer in answers:
        if is_empty(answer):
            out.append("empty")
            continue
        asked = asked or _Asked(prompt or "", profiles)
        if is_copy(asked, answer):
            out.append("copied_prompt")
        elif is_refusal(answer):
            out.append("refusal")
        elif is_foreign(asked, answer, profiles):
            out.append("other_language")
        else:
            out.append("truncated" if is_truncated(answer, profiles) else None)
    return out


def defect(prompt: str | None, answer: str | None, profiles: Profiles) -> str | None:
    return defects(prompt, [answer], profiles)[0]


def pair_defects(df: DataFrame, profiles: Profiles | None = None, id_col: str = "pair_id", prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``(id_col, side, defect)``, one row per broken side of a pair.

    ``defect`` is empty, copied_prompt, refusal, other_language or truncated,
    the first that holds. ``profiles`` tell languages of the Latin script apart
    (``languages.fit_profiles``); without them only scripts do. A null answer is
    empty; a null prompt is one without a word, to which nothing is a copy and
    no language is foreign. Repeated rows count once; rows that share an id but
    differ are all reported. An empty table gives an empty result, other columns
    are ignored.
    """
    kind = dict(df.dtypes)[id_col]
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected")))
    sent = df.sparkSession.sparkContext.broadcast(profiles or Profiles())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for pdf in batches:
            out = []
            for i, p, c, r in zip(pdf["id"], pdf["prompt"], pdf["chosen"], pdf["rejected"]):
                out += [(i, side, found) for side, found in zip(("chosen", "rejected"), defects(p, [c, r], known)) if found]
            yield pd.DataFrame(out, columns=[id_col, "side", "defect"])

    return rows.mapInPandas(run, f"`{id_col}` {kind}, side string, defect string").distinct()
