"""Sentence units of documents in spaced and spaceless scripts.

Layout comes first: fenced code, headings, list entries and blank lines bound
units. Inside a paragraph every end mark, and every quotation or bracket that
closes behind one, is a node of a lattice.

* Terminator lattice: an edge is the span between two nodes. It has the score of
  the mark that ends it (abbreviations, initials, ordinals, numbers, the word
  that follows), pays for each end that leaves a quotation or bracket open, needs
  a letter or digit, and a closing quotation or bracket counts by what its span
  holds before it: a reported quotation, a quotation of its own, a sentence in
  brackets. The best path gives the cuts, wherever the edges are weighed against
  each other, in time linear in the nodes.
* Spaceless scripts: the runs of letters beside a mark are divided into words by
  the cheapest path through a dictionary word lattice. Final particles before a
  gap, and opening, carrying and reporting words after it, score the node; the
  mark itself is only the prior. Line breaks always separate, and in Thai so
  does a blank between two Thai characters.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.runtime import spread

#: Words of the dictionary: entries of a public tokenizer's vocabulary.
DICTIONARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed values. Abbreviations are written without blanks and without the last dot.
#: The sentence always runs on after these.
RUNS_ON = frozenset(
    """dr prof mr mrs ms st sr sra dra mme mlle messrs gen col capt lt sgt rev hon pres gov
    e.g i.e cf vs approx ca est esp incl resp viz al z.b d.h u.a bzgl bzw insb vgl ggf evtl sog inkl zzgl ca mind hrsg hr fr
    c.-à-d c.à.d p.ex env p.ej aprox ud uds d.ª т.е т.к напр ок см ср г-н г-жа им проф акад тов стр
    डॉ श्री श्रीमती प्रो د أ م max""".split()
)
#: These belong to a number that follows them.
BEFORE_NUMBER = frozenset("no nr nos núm n fig figs tab sec secs abb s p pp pág págs art arts kap ch chap vol bd eq гл рис разд табл п т с ст пункт सं पृ ص رقم min max est".split())
#: The sentence runs on after these unless an opening word follows.
MAY_END = frozenset("etc usw usf u.s.w hrs hr min mins sec p.m a.m u.k u.s u.n e.u e.e.u.u ee.uu ee p.m. т.д т.п др пр inc ltd co corp jr bros dept std mio mrd jh ff kg km cm mm mg гг г в руб тыс млн млрд".split())
#: German words before an ordinal number.
BEFORE_ORDINAL = frozenset("der die das den dem des am im vom zum zur beim jeder jede jedes ein eine einem einen einer ab bis seit nach und".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
#: Words that open a sentence, and words that carry one on, in zh and ja.
OPENING = frozenset("因为 为什么 为何 如果 虽然 但是 然而 所以 因此 不过 我们 他们 她们 你们 他 她 它 我 你 这 那 之前 随后 接着 最后 首先 其次 此外 另外 今天 昨天 现在 后来 同时 なぜ しかし また そして ただし 次に 最後 まず この その あの さらに 一方 だから それで でも つまり".split())
CARRYING = frozenset("结果 却 就 才 又 而 并 的 地 得 和 或 以及 等 等等 は が を に へ と で も の や から まで より など って という とは として について だけ とか".split())
#: Carrying words that can't follow a finished sentence, whatever mark ended it.
ATTACHED = frozenset("的 と って という とは を".split())
#: Words that report what was said.
REPORTING = frozenset("说 问 答 写 道 说道 问道 答道 写道 喊 喊道 叫道 回答 表示 指出 补充 解释 认为 称 告诉 心想 想 反问 追问 感叹 提醒 宣布".split())
#: Words and particles that end a sentence in zh and ja.
FINAL = frozenset("了 吗 呢 吧 啊 呀 嘛 的 过 着 だ た か ね よ な です ます ない した である ました ません だった でした".split())

_HAN_KANA = "぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ々"
_SPACELESS = re.compile(f"[{_HAN_KANA}฀-๿]")
#: A particle with the beginning of the next word: an entry of the vocabulary, but no word.
_GLUED = re.compile("[ぁ-ん][㐀-䶿一-鿿]")
_CJK = re.compile(f"[{_HAN_KANA}]")
_RUN = re.compile(f"[{_HAN_KANA}]+")
_ENDS = ".!?…。！？．｡؟।॥۔"
_LETTER = re.compile(r"[^\W\d_]")
_LINE = re.compile(r"([^\r\n\x0b\x0c\x1c-\x1e\x85  ]*)(\r\n|[\r\n\x0b\x0c\x1c-\x1e\x85  ]|$)")
_FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"\s{0,3}#{1,6}(?:\s|$)")
_BULLET = re.compile(r"\s*[-*+•‣◦▪·–]\s+\S")
_NUMBERED = re.compile(r"\s*(?:\d{1,3}[.)．、]|[a-zA-Z]\)|[(（]\d{1,3}[)）])\s+\S")
_IDENTIFIER = re.compile(r"(?:[a-z]+(?:-[a-z]+)+-\d+|v\d+(?:\.\d+)+|[a-z_][\w]*\.[a-z]{1,8}|[b-df-hj-np-tv-z]{2,3})(?=[\s,;:)]|$)")
_MARK = re.compile(r"[.!?…。！？．｡؟।॥۔]+|[\"“”„‟«»「」『』()（）\[\]【】]")
_STRONG = "。！？｡؟।॥۔"
_NUMBERING = re.compile(r"(?:[^\W\d_]+\s+)?(?:\d+|[A-Z]|[IVX]+)(?:\.\d+)*\.\s+")
_THAI_BLANK = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])")
_OPENERS = {"“": "”", "„": "“”", "‟": "”", "«": "»", "「": "」", "『": "』", "(": ")）", "（": "）)", "[": "]", "【": "】"}
_CLOSERS = "”»」』)）]】"
_BRACKETS = "(（[【"
_STARTS = "“„«「『(（[【¿¡\""


class Words:
    """Divides runs of spaceless scripts into words of a public vocabulary.

    A word costs more the later its rank, an unknown letter more than any word;
    the words that classify gaps are known whatever the vocabulary holds.
    """

    def __init__(self, path: str):
        self.costs: dict[str, float] = {}
        for line in Path(path).read_bytes().splitlines():
            token, _, rank = line.partition(b" ")
            try:
                word = base64.b64decode(token).decode()
            except UnicodeDecodeError:
                continue
            if word and _RUN.fullmatch(word) and not _GLUED.search(word):
                self.costs[word] = 2.0 + min(int(rank), 50_000) / 25_000
        for w in OPENING | CARRYING | FINAL | REPORTING:
            self.costs[w] = min(self.costs.get(w, 9.0), 2.0)
        lengths: dict[str, set[int]] = {}
        for w in self.costs:
            lengths.setdefault(w[0], set()).add(len(w))
        self.lengths = {c: sorted(n) for c, n in lengths.items()}
        self._seen: dict[str, list[str]] = {}

    def path(self, run: str) -> list[str]:
        """The cheapest path through the lattice of words over the whole run."""
        got = self._seen.get(run)
        if got is not None:
            return got
        n, costs, lengths = len(run), self.costs, self.lengths
        best, back = [0.0] + [1e18] * n, [0] * (n + 1)
        for i in range(n):
            here = best[i]
            if here + 6.0 < best[i + 1]:
                best[i + 1], back[i + 1] = here + 6.0, i
            for size in lengths.get(run[i], ()):
                j = i + size
                if j > n:
                    break
                c = costs.get(run[i:j])
                if c is not None and here + c < best[j]:
                    best[j], back[j] = here + c, i
        out, j = [], n
        while j:
            out.append(run[back[j] : j])
            j = back[j]
        out.reverse()
        if len(self._seen) > 20_000:
            self._seen.clear()
        if n <= 200:
            self._seen[run] = out
        return out


@lru_cache(maxsize=4)
def dictionary(path: str) -> Words:
    return Words(path)


def _before(text: str, k: int, s: int, words: Words) -> list[str]:
    """Words of the run that ends at k."""
    j = k
    while j > s and _CJK.match(text[j - 1]):
        j -= 1
    return words.path(text[j:k]) if j < k else []


def _after(text: str, k: int, e: int, words: Words) -> tuple[list[str], int]:
    """Words of the run that begins at k, and where it ends."""
    m = _RUN.match(text, k, e)
    return (words.path(m[0]), m.end()) if m else ([], k)


def _spaceless_gap(text: str, s: int, i: int, k: int, e: int, words: Words, prior: float, told: bool = False) -> float:
    """Score of a cut between the run that ends at i and the one that begins at k.

    ``told``: a quotation ends at the gap, and nothing has introduced it yet.
    """
    after, end = _after(text, k, e, words)
    score = prior
    if after:
        if after[0] in CARRYING:
            score -= 5.0 if after[0] in ATTACHED else 3.0
        elif after[0] in OPENING:
            score += 1.0
        if told and any(w in REPORTING for w in after) and text[end : end + 1] not in ("：", ":", "“", "「", "『"):
            score -= 4.0
    elif k < e and text[k] in _STARTS:
        score += 2.0
    before = _before(text, i, s, words)
    if before:
        score += 0.5 if before[-1] in FINAL else -0.5
    return score


def _token_before(text: str, s: int, i: int) -> tuple[str, str]:
    """The token that ends at i, and the one before it, without outer marks."""
    j = i
    while j > s and not text[j - 1].isspace():
        j -= 1
    token = text[j:i].lstrip("\"“„«([（¿¡'’")
    k = j
    while k > s and text[k - 1].isspace():
        k -= 1
    h = k
    while h > s and not text[h - 1].isspace():
        h -= 1
    return token, text[h:k].lstrip("\"“„«([（¿¡'’")


def _pairs(text: str, s: int, e: int, marks: list[re.Match]) -> dict[int, int]:
    """Openers and their closers; those without a partner are left out."""
    stack: list[tuple[int, str]] = []
    pair: dict[int, int] = {}
    for m in marks:
        c, p = m[0], m.start()
        if c == '"':
            if any(o == '"' for _, o in stack):
                while stack:
                    q, o = stack.pop()
                    if o == '"':
                        pair[q] = p
                        break
            elif p == s or not text[p - 1].isdigit() or text[p - 1 : p] == "":
                stack.append((p, '"'))
        elif c in _OPENERS and not (c == "“" and stack and stack[-1][1] == "„"):
            stack.append((p, c))
        elif c in "”“»」』)）]】":
            for d in range(len(stack) - 1, -1, -1):
                if c in _OPENERS.get(stack[d][1], ""):
                    pair[stack[d][0]] = p
                    del stack[d:]
                    break
    return pair


def _dot(text: str, s: int, i: int, k: int, e: int, spaced: bool, cased: bool) -> float:
    """Score of ending a sentence with the single dot at i; k: where it goes on."""
    nxt = text[k]
    prev = text[i - 1] if i > s else " "
    token, earlier = _token_before(text, s, i)
    rest = text[k : k + 40]
    if not spaced:
        if nxt in _STARTS:
            return 1.0 if prev.isalnum() and nxt not in "[(" else -1.0
        if _CJK.match(prev) or (_CJK.match(nxt) and not prev.isascii()):
            return 3.0
        if nxt.isalpha() and (prev.isalnum() or prev in "%)"):
            if nxt.isupper():
                word = token.rpartition(".")[2]
                after = text[k + 1 : k + 2]
                if len(word) > 1 and (after.islower() or after in " '’") or prev.isdigit() and after.islower():
                    return 1.5
                return -2.0
            if not nxt.islower():  # no case: Arabic, Devanagari
                return 1.5 if len(token) > 1 and not token.isascii() or prev.isdigit() else -2.0
            if re.match(r"[a-z]+-[a-z]+-\d+\b", rest) and re.fullmatch(r"[^\W\d_]{2,}", token):
                return 1.0
        return -3.0
    key = token.lower().rstrip(".")
    two = (earlier.lower() + key) if earlier.endswith(".") and len(key) <= 3 else ""
    opens = nxt.isupper() or nxt in _STARTS or (nxt.isalpha() and not nxt.islower()) or bool(_IDENTIFIER.match(rest))
    if two in MAY_END or (key in MAY_END and not (key in BEFORE_NUMBER and nxt.isdigit())):
        return 1.0 if (opens or (nxt.isdigit() and key not in ("min", "max"))) and key != "ee" else -2.0
    if two in RUNS_ON or key in RUNS_ON and not (key in ("st", "al", "fr", "hr", "est", "max", "د", "أ", "م") and nxt in _STARTS):
        return -3.0
    if key in BEFORE_NUMBER and nxt.isdigit():
        return -3.0
    if key in ("n", "s", "p", "т", "п", "с", "г", "z", "d", "u", "e", "i", "a") and token.islower() and re.match(r"[^\W\d_]{1,2}\.|ej\.", rest):
        return -3.0
    if key == "cf" or key == "fig":
        return -3.0
    if len(token) == 1 and token.isupper() and nxt.isupper():
        return -2.0
    if token.isdigit() and len(token) <= 2 and nxt.isalpha():
        following = re.match(r"\w+", rest)
        if following and (earlier.lower() in BEFORE_ORDINAL and nxt.isupper() or following[0].lower() in MONTHS) and not earlier.endswith((".", ",")):
            return -2.0
    if nxt in ",;:)]）–—-%":
        return -3.0
    if nxt.islower() and not _IDENTIFIER.match(rest):
        letter = next((c for c in reversed(token) if c.isalpha()), "a")
        caseless = letter.lower() == letter.upper()
        return 1.0 if caseless or not cased else -1.0
    return 3.0


def _ellipsis(text: str, s: int, i: int, j: int, k: int, e: int, words: Words) -> float:
    nxt = text[k]
    if _CJK.match(nxt) or (i > s and _CJK.match(text[i - 1])):
        return _spaceless_gap(text, s, i, k, e, words, 0.0)
    if k == j and not nxt.isupper() and nxt not in _STARTS:
        return -3.0
    rest = text[k : k + 40]
    return 2.0 if nxt.isupper() or nxt in _STARTS or nxt.isdigit() or (nxt.isalpha() and not nxt.islower()) or _IDENTIFIER.match(rest) else -2.0


def _after_quote(text: str, s: int, opened: int, j: int, k: int, e: int, words: Words) -> tuple[float, float]:
    """Scores of a cut behind a quotation that ends with an end mark: where text
    goes before it in the span, and where the quotation opens the span."""
    nxt, h = text[k], opened
    while h > s and text[h - 1].isspace():
        h -= 1
    introduced = h > s and text[h - 1] in ":："
    if nxt in ",，、;；:：)）]—–-.。…!?" or (nxt.islower() and not (introduced and _IDENTIFIER.match(text[k : k + 40]))):
        return -3.0, -3.0
    if _CJK.match(nxt):
        score = _spaceless_gap(text, s, j, k, e, words, 1.5, not introduced)
        return score, score
    if introduced or nxt in _STARTS or nxt.isupper() or nxt.isdigit():
        return 2.0, 2.0
    return 1.0, -2.0


#: What a span pays for an end inside a quotation or bracket.
OPEN_END = 4.0


def _best_path(text: str, s: int, e: int, nodes: list[tuple[int, float, float, int, bool]]) -> list[int]:
    """Cuts of the path of highest score through the lattice of end marks.

    A node is (cut, score with text before its quotation, score without, where
    that text ends, inside a quotation). Edges lead over text with a letter or
    digit. The best way to each node comes from running maxima over the nodes
    before it, so all edges are weighed in one pass.
    """
    cuts, value, best, back = [s], [0.0], [0], [0]  # value: of the path up to a node, its next open end paid
    seen, last = s, -1  # the last letter before seen
    for cut, told, fresh, edge, inside in nodes:
        k = cut
        while k > seen and not text[k - 1].isalnum():
            k -= 1
        seen, last = max(cut, seen), k - 1 if k > seen else last
        score, origin = -1e18, 0
        if last >= 0:
            upto = bisect_right(cuts, last) - 1
            split = upto
            if told != fresh:
                k = edge
                while k > s and not text[k - 1].isalnum():
                    k -= 1
                split = bisect_right(cuts, k - 1) - 1 if k > s else -1
                for n in range(upto, split, -1):
                    if value[n] + fresh > score:
                        score, origin = value[n] + fresh, n
            if split >= 0 and value[best[split]] + told > score:
                score, origin = value[best[split]] + told, best[split]
        cuts.append(cut)
        value.append(score - (2 * OPEN_END if inside else 0.0))
        best.append(len(cuts) - 1 if value[-1] > value[best[-1]] else best[-1])
        back.append(origin)
    k = e
    while k > s and not text[k - 1].isalnum():
        k -= 1
    if k == s:
        return []
    n, out = best[bisect_right(cuts, k - 1) - 1], []
    while n:
        out.append(cuts[n])
        n = back[n]
    return out[::-1]


def _sentences(text: str, s: int, e: int, thai: bool, words: Words) -> list[int]:
    """Where the piece [s, e) of a paragraph is cut."""
    marks = list(_MARK.finditer(text, s, e))
    blanks = [m for m in _THAI_BLANK.finditer(text, s, e)] if thai else []
    if not marks and not blanks:
        return []
    pair = _pairs(text, s, e, quoting) if (quoting := [m for m in marks if m[0][0] not in _ENDS]) else {}
    closing = {c: o for o, c in pair.items()}
    cased = any(c.isupper() for c in text[s:e]) or not any(c.islower() for c in text[s:e])
    nodes: list[tuple[int, float, float, int, bool]] = []
    depth, ended_at = 0, -1  # ended_at: the last closer with an end mark before it

    def skip(j: int) -> int:
        while j < e and text[j].isspace():
            j += 1
        return j

    def node(cut: int, told: float, fresh: float | None = None, edge: int = 0) -> None:
        nodes.append((cut, told, told if fresh is None else fresh, edge, depth > 0))

    events = sorted([(m.start(), m.end(), "mark") for m in marks] + [(m.start(), m.end(), "blank") for m in blanks])
    for i, j, kind in events:
        if kind == "blank":
            node(i, 3.0)
            continue
        c = text[i]
        if i in pair:
            depth += 1
            continue
        if i in closing:
            depth -= 1
            k, opened = skip(j), closing[i]
            b = i
            while b > opened and text[b - 1].isspace():
                b -= 1
            if text[b - 1] not in _ENDS and ended_at != b - 1:
                continue
            ended_at = i
            if k >= e:
                continue
            if text[opened] in _BRACKETS:
                nxt = text[k]
                alone = text[b - 1] != "…" and not nxt.islower() and nxt not in ",，、;；:：.。!?"
                node(j, -3.0, 2.0 if alone or _IDENTIFIER.match(text[k : k + 40]) else -3.0, opened)
            elif k > j or not text[k].isascii() or text[k].isupper() or text[k] in _STARTS:
                node(j, *_after_quote(text, s, opened, j, k, e, words), opened)
            continue
        if c not in _ENDS:
            continue
        while j < e and text[j] in "”»」』)）]】’\"" and j not in closing and j not in pair:
            j += 1
        k = skip(j)
        if k >= e:
            continue
        run = text[i:j]
        nxt = text[k]
        if thai and c in ".…":
            continue
        if any(x in _STRONG for x in run):
            if nxt in ",，、;；":
                continue
            node(j, _spaceless_gap(text, s, i, k, e, words, 5.0 if c == "。" else 4.0) if _CJK.match(nxt) else 4.0)
        elif "?" in run or "!" in run:
            if nxt in ",，、;；:：)）":
                continue
            node(j, 3.0 if k > j or nxt.isupper() or nxt in _STARTS or (nxt.isalpha() and not nxt.isascii() and not nxt.islower()) or (_CJK.match(text[i - 1] if i > s else " ") is not None) else -2.0)
        elif "…" in run or len(run.rstrip("”»」』)）]】’\"")) > 1:
            node(j, _ellipsis(text, s, i, j, k, e, words))
        elif c == "．":
            node(j, 3.0 if not (k == j and nxt.isdigit() and i > s and text[i - 1].isdigit()) else -3.0)
        else:
            node(j, _dot(text, s, i, k, e, k > j, cased))
    return _best_path(text, s, e, nodes)


def _numbered_title(text: str, s: int, e: int) -> bool:
    """A line without an end mark whose only inner marks are dots of its numbering."""
    body = text[s:e].strip()
    if body[-1:] in _ENDS + "\"”»」』)）":
        return False
    numbering = _NUMBERING.match(body)
    return bool(numbering) and not _MARK.search(body, numbering.end())


def _blocks(text: str) -> Iterator[tuple[str, int, int]]:
    """Code, headings, list entries and paragraphs with their extents."""
    lines = [(m.start(1), m.end(1)) for m in _LINE.finditer(text)]
    kind, begun, ended = "", 0, 0
    k = 0
    while k < len(lines):
        s, e = lines[k]
        line = text[s:e]
        fence = _FENCE.match(line)
        if fence:
            if kind:
                yield kind, begun, ended
                kind = ""
            close = next((q for q in range(k + 1, len(lines)) if text[lines[q][0] : lines[q][1]].strip().startswith(fence[1]) and not text[lines[q][0] : lines[q][1]].strip().strip(fence[1][0])), None)
            last = len(lines) - 1 if close is None else close
            yield "code", s, lines[last][1]
            k = last + 1
            continue
        if not line.strip():
            if kind:
                yield kind, begun, ended
            kind = ""
        elif _HEADING.match(line):
            if kind:
                yield kind, begun, ended
            yield "heading", s, e
            kind = ""
        elif _BULLET.match(line) or (kind != "text" and _NUMBERED.match(line)):
            if kind:
                yield kind, begun, ended
            kind, begun, ended = "entry", s, e
        elif kind:
            ended = e
        else:
            kind, begun, ended = "text", s, e
        k += 1
    if kind:
        yield kind, begun, ended


def _trim(text: str, s: int, e: int) -> tuple[int, int] | None:
    while s < e and text[s].isspace():
        s += 1
    while e > s and text[e - 1].isspace():
        e -= 1
    return (s, e) if s < e else None


def segment(text: str | None, words: Words | None = None) -> list[tuple[int, int]]:
    """Offsets of the sentence units of a text, in code points, end exclusive.

    Null, empty and blank texts have none. Units have no white space at their
    ends, and every other character is in exactly one unit.
    """
    if not text:
        return []
    words = words or dictionary(DICTIONARY)
    units: list[tuple[int, int]] = []

    def add(s: int, e: int) -> None:
        if t := _trim(text, s, e):
            units.append(t)

    for kind, s, e in _blocks(text):
        if kind != "text":
            add(s, e)
            continue
        body = text[s:e]
        dense = len(_SPACELESS.findall(body)) if max(body) >= "\u0e00" else 0
        spaceless = dense > 0 and dense * 5 >= len(_LETTER.findall(body))
        thai = spaceless and bool(re.search(r"[฀-๿]", body))
        pieces = [(m.start(1), m.end(1)) for m in _LINE.finditer(text, s, e) if m.start(1) < m.end(1)] if spaceless else [(s, e)]
        if len(pieces) == 1 and not spaceless and not re.search(r"[\r\n]", body.strip()) and _numbered_title(text, s, e):
            add(s, e)
            continue
        for ps, pe in pieces:
            last = ps
            for cut in _sentences(text, ps, pe, thai, words):
                add(last, cut)
                last = cut
            add(last, pe)
    return units


def sentence_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary_path: str = DICTIONARY) -> DataFrame:
    """One row ``(id_col, char_start, char_end)`` per sentence unit.

    Null, empty and blank texts give no row; rows with a null id keep it. Rows
    repeated in the input repeat in the result. Other columns are ignored, and
    an empty table gives an empty one. One narrow stage, no shuffle: the work
    of a text is linear in its length.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = dictionary(dictionary_path)
        for pdf in batches:
            ids, starts, ends = [], [], []
            for i, text in zip(pdf["id"], pdf["text"]):
                for s, e in segment(text, words):
                    ids.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pd.DataFrame({id_col: pd.Series(ids, dtype="object" if kind != "bigint" or any(i != i for i in ids) else "int64"), "char_start": pd.Series(starts, dtype="int64"), "char_end": pd.Series(ends, dtype="int64")})

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return spread(source).mapInPandas(run, f"`{id_col}` {kind}, char_start long, char_end long")
