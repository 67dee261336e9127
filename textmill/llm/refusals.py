"""Refusals, by alignment with templates made of slots.

A sentence is brought to a sequence of slots: apology, the speaker, being unable
or unwilling, an act of answering, guidelines, what is asked. What fills a slot
is listed for each language; templates say in which order slots make a refusal,
and a clause refuses if one of them is a common subsequence. So a wording that
nobody listed is found if its parts are known. What is left beside the slots
is the topic; a clause that says something of its own, or an exception
("except", "without"), makes the answer more than a refusal.
"""

from __future__ import annotations

import re
from itertools import chain

from textmill.llm.words import WORD

# Fixed values. Slots and what fills them; ";" separates fillers, blanks words. Languages follow each other: en, de, fr, es, it, nl, pt, pl, ru, zh, ja.
SLOTS = {
    "SORRY": """sorry; i m sorry; i am sorry; we re sorry; we are sorry; my apologies; apologies; i apologize; i apologise; unfortunately; regrettably; i regret; i m afraid; i am afraid; sadly; with regret
        ; tut mir leid; es tut mir leid; leider; bedaure; ich bedaure; bedauerlicherweise; entschuldigung; verzeihung; entschuldigen sie
        ; désolé; désolée; je suis désolé; je suis désolée; navré; malheureusement; je regrette; pardon; excusez moi; je crains que
        ; lo siento; lo sentimos; lamentablemente; desafortunadamente; por desgracia; me temo que; me temo; perdón; disculpa; disculpe; lamento
        ; mi dispiace; purtroppo; spiacente; sono spiacente; scusa; scusi; mi scuso; temo di; temo che
        ; het spijt me; helaas; excuses; mijn excuses; pardon
        ; desculpe; desculpa; lamento; sinto muito; infelizmente; lamentavelmente
        ; przykro mi; niestety; przepraszam; wybacz
        ; извините; извини; простите; к сожалению; сожалею; мне жаль; увы
        ; 抱歉; 很抱歉; 非常抱歉; 对不起; 不好意思; 很遗憾; 遗憾的是
        ; 申し訳ありませんが; 申し訳ありません; 申し訳ございませんが; 申し訳ございません; すみませんが; すみません; 残念ながら; 恐れ入りますが; あいにくですが; あいにく; ごめんなさい""",
    "SELF": """i; i m; i am; we; we re; we are; me; my; us; ich; wir; mir; uns; mich; je; j; nous; me; moi; yo; nosotros; me; io; noi; ik; wij; mij; eu; nós; ja; my; я; мы; мне; нам; 我; 我们; 本人; 本助手; 私; 私ども; 当方; こちら""",
    "MODEL": """as a language model; as an ai language model; as an ai; as an assistant; as an ai assistant; as ai; als sprachmodell; als ki; als assistent; en tant que modèle de langue; en tant qu ia; en tant qu assistant; como modelo de lenguaje; como ia; como asistente
        ; come modello linguistico; come ia; als taalmodel; como modelo de linguagem; jako model językowy; как языковая модель; как ии; 作为语言模型; 作为ai; 作为人工智能; 言語モデルとして; aiとして; アシスタントとして""",
    "CAN": """can; able; able to; permitted; permitted to; allowed; allowed to; allow; allows; permit; permits; comfortable; at liberty; at liberty to; in a position; in a position to; authorized; authorised; free to; entitled; qualified; supposed
        ; kann; können; darf; dürfen; möchte; möchten; will; wollen; werde; werden; befugt; berechtigt; erlaubt; erlauben; gestattet; imstande; in der lage; bereit; möglich
        ; peux; pouvons; puis; peut être; souhaite; veux; voulons; vais; suis pas autorisé; autorisé; autorisée; permis; permise; permettent; permet; en mesure; habilité; habilitée; disposé; possible; dois
        ; puedo; podemos; quiero; deseo; voy; autorizado; autorizada; permitido; permiten; permite; en condiciones; capaz; posible; debo; dispuesto
        ; posso; possiamo; voglio; sono autorizzato; autorizzato; permesso; consentito; in grado; possibile; intendo
        ; kan; mag; wil; kunnen; mogen; bevoegd; toegestaan; in staat; mogelijk
        ; posso; podemos; quero; vou; autorizado; permitido; capaz; possível
        ; mogę; możemy; wolno; chcę; będę; w stanie
        ; могу; можем; хочу; буду; будем; вправе; разрешено; позволено; позволяют; позволяет; уполномочен; готов; стану; могут; в состоянии; возможно""",
    "NOT": """not; t; cannot; never; no; nothing; nicht; nichts; kein; keine; keinen; pas; rien; ne; n; no; nada; non; niente; nulla; niet; niets; geen; não; nie; nic; не; ничего; нет""",
    "UNABLE": """cannot; cant; can t; can not; couldn t possibly; unable; unable to; incapable of; not able to; am not able to; außerstande; nicht imstande; incapable de; incapaz de; onmogelijk; не в состоянии; не могу; нельзя; невозможно; не вправе; не имею права
        ; 无法; 不能; 不便; 不可以; 没法; 没办法; 无权; 不宜; 不方便; 不被允许; 未被允许; 不允许; 不会; 难以; 恕不; 不予
        ; できません; できかねます; いたしかねます; 致しかねます; しかねます; かねます; できない; 許されていません; 許可されていません; られません; えません; 難しいです""",
    "UNWILLING": """won t; wont; will not; refuse to; refuse; i decline; decline to; must decline; have to decline; have to refuse; must refuse; rather not; would rather not; d rather not; prefer not to; prefer not; would prefer not; choose not to; won t be; have to pass; must pass; not going to; not willing to; unwilling to; not inclined to; do not wish to; don t wish to; don t want to; do not want to; do not give; don t give; do not offer; do not provide; don t provide; don t discuss; do not discuss; do not comment; don t do
        ; passen; muss passen; muss ich passen; muss ablehnen; lehne ab; lehne es ab; lehne ich ab; ablehnen; weigere; weigere mich; verweigere; lieber nicht; enthalte mich; äußere mich nicht; möchte nicht; möchte mich nicht; gebe keine; erteile keine; verzichte
        ; préfère ne pas; préférons ne pas; refuse de; refuse; refusons; dois refuser; dois décliner; décline; m abstiens; m abstenir; ne souhaite pas; ne donne pas; ne veux pas
        ; prefiero no; preferimos no; me niego; me niego a; debo negarme; rechazo; declino; debo declinar; me abstengo; no doy; no quiero; no deseo; no ofrezco
        ; preferisco non; preferirei non; mi rifiuto; rifiuto; devo rifiutare; non do; devo declinare; non intendo; non voglio
        ; liever niet; weiger; ik weiger; moet weigeren; geef geen; wil niet
        ; prefiro não; recuso; recuso me; me recuso; devo recusar; não dou; não quero
        ; wolę nie; odmawiam; muszę odmówić; nie chcę; nie udzielam
        ; предпочитаю не; предпочту не; отказываюсь; вынужден отказаться; вынуждена отказаться; вынужден отказать; должен отказаться; воздержусь; не буду; не стану; не хочу; не даю; не желаю
        ; 拒绝; 不想; 不愿; 不愿意; 选择不; 恕难; 恕我不能; 恕我; 谢绝; 不提供; 不予; 不打算; 不做
        ; 控えさせていただきます; 控えさせて; 控えます; 差し控えます; 差し控えさせて; お断りします; お断り; 拒否します; しないでおきます; ご遠慮; 遠慮します; 助言はしません; はしません""",
    "ACT": """answer; answers; answering; answered; respond; responding; response; reply; replying; help; helping; help you; assist; assisting; assist you; assistance; discuss; discussing; comment; commenting; talk; talking; speak; speaking; say; say anything; say more; tell you; provide; providing; provided; give; given; offer; share; sharing; disclose; reveal; advise; advise on; advice; engage; engage in; comply; fulfil; fulfill; complete; support; do that; do this; go into; get into; touch on; weigh in; compare; recommend; judge; rank; explain; write; generate; information; opinion; opine; address; handle; process; grant; request
        ; beantworten; beantwortet; antworten; antwort; helfen; geholfen; weiterhelfen; äußern; sagen; sprechen; reden; diskutieren; kommentieren; auskunft; auskünfte; geben; nennen; erklären; raten; ratschläge; rat; unterstützen; behilflich; stellung nehmen; stellung; bearbeiten; eingehen; dienen
        ; répondre; réponse; aider; parler; discuter; aborder; commenter; dire; donner; donner suite; fournir; conseiller; conseils; assister; partager; traiter; révéler; évoquer; exprimer; prononcer; renseigner
        ; responder; respuesta; ayudar; ayudarle; ayudarte; hablar; discutir; comentar; decir; dar; ofrecer; opinar; contestar; aconsejar; consejos; asistir; compartir; tratar; proporcionar; revelar; facilitar; atender
        ; rispondere; risposta; aiutare; aiutarti; aiutarla; aiutarvi; parlare; discutere; commentare; dire; dare; fornire; consigliare; consigli; assistere; trattare; condividere; rivelare; esprimermi
        ; antwoorden; beantwoorden; antwoord; helpen; praten; bespreken; zeggen; geven; spreken; ingaan; verstrekken; advies; commentaar; delen; bijstaan
        ; responder; resposta; ajudar; ajudá lo; falar; discutir; comentar; dizer; fornecer; aconselhar; conselhos; opinar; compartilhar; dar
        ; odpowiedzieć; odpowiadać; odpowiedź; odpowiedzi; pomóc; pomagać; rozmawiać; omawiać; komentować; powiedzieć; udzielić; doradzać; porad; mówić
        ; ответить; отвечать; ответа; ответ; помочь; помогать; обсуждать; обсудить; говорить; сказать; комментировать; рассказать; дать; предоставить; советовать; советы; советов; совет; подсказать; ответов; рассуждать; высказываться
        ; 回答; 答复; 讨论; 谈论; 谈; 提供; 帮助; 帮忙; 帮上忙; 帮您; 帮你; 协助; 评论; 透露; 告诉; 多说; 说明; 建议; 回应; 满足; 处理; 发表; 多谈
        ; お答え; 答え; 回答; お話し; 話; お手伝い; 手伝; 助言; コメント; 提供; 対応; お力; お伝え; 説明; 議論; 助け; お応え; 応じ; アドバイス""",
    "RULES": """guidelines; policy; policies; rules; instructions; principles; restrictions; richtlinien; regeln; vorgaben; consignes; directives; règles; règlement; normas; reglas; políticas; directrices; linee guida; regole; richtlijnen; regels; diretrizes; regras; zasady; wytyczne; правила; правилам; инструкции; политика; 准则; 规定; 政策; 规则; ガイドライン; 規則; ポリシー; 方針""",
    "FORBID": """forbid; forbids; prohibit; prohibits; prevent me; prevents me; keep me from; keeps me from; verbieten; verbietet; untersagen; untersagt; interdisent; interdit; m interdisent; m interdit; prohíben; prohíbe; me impiden; vietano; verbieden; proíbem; zabraniają; запрещают; запрещает; не допускают; 禁止; 不允许我; 禁じられて; 禁じて""",
    "ITEM": """this question; that question; your question; the question; this request; that request; your request; this topic; this subject; this matter; that; this; it; such requests; these questions; diese frage; dieser frage; dieser anfrage; diese anfrage; dazu; dabei; das; darüber; hierzu; hierbei; damit; das thema; diesem thema
        ; cette question; cette demande; ce sujet; cela; ça; y; votre demande; votre question; esta pregunta; esa pregunta; este tema; esta solicitud; eso; esto; su pregunta; questa domanda; questa richiesta; questo argomento; questo; ciò; deze vraag; dit verzoek; dit onderwerp; dit; daarmee; hiermee; daarover; esta pergunta; este assunto; este pedido; isso; to pytanie; tym; tego; na to pytanie; этот вопрос; на этот вопрос; этой теме; эту тему; этим; это; об этом; этого
        ; 这个问题; 此问题; 该问题; 您的问题; 你的问题; 这一问题; 此类问题; 该请求; 这个请求; 您的请求; 此事; 这件事; 这个话题; 该话题; 这方面; このご質問; この質問; その質問; ご質問; その件; この件; そのご質問; ご要望; この話題; その内容; の内容; については; についての; に関しては; に関する; には; 質問は; 件は; 回答は; お答えは; お返事は""",
    "OUTSIDE": """outside; beyond; off limits; out of scope; against; violates; violate; not something; isn t something; nothing; außerhalb; verstößt; gegen; hors de; hors du; au delà; contraire; fuera de; más allá; contra; fuori; oltre; buiten; fora; além; poza; вне; за пределами; за рамки; выходит за; противоречит; 超出; 超出了; 违反; 不属于; 範囲外; 反します; 反する""",
    "OFFER": """is there anything else; anything else; anything else i can help with; can i help with anything else; can i help you with anything else; let me know if there is anything else; you would like to know; would you like to know; feel free to ask; happy to help with something else; thank you for the question; thank you for your question; thanks for the question; thanks for asking; thank you for asking; thank you; please ask someone else; ask someone else; please consult; please contact; there may be better places to ask; better places; i would ask you not to insist; ask you not to insist; please understand; thanks for understanding; thank you for your understanding; sorry for the inconvenience; i hope you understand; however harmless it may be; however harmless
        ; kann ich sonst etwas tun; kann ich sonst noch helfen; kann ich sonst; haben sie noch fragen; haben sie weitere fragen; danke für die frage; danke für ihre frage; bitte wenden sie sich an jemand anderen; bitte wenden sie sich; wenden sie sich; ich bitte um verständnis; bitte um verständnis; vielen dank für die frage; vielen dank; danke für ihr verständnis
        ; puis je vous aider autrement; puis je aider autrement; autre chose; avez vous d autres questions; merci pour la question; merci de votre question; merci de votre compréhension; merci; veuillez vous adresser; adressez vous
        ; algo más; puedo ayudar en algo más; puedo ayudarle en algo más; tiene otras preguntas; gracias por la pregunta; gracias por su comprensión; gracias; consulte; pregunte a otra persona
        ; posso aiutarti in altro; altro; grazie per la domanda; grazie; altre domande; kan ik nog iets; anders nog iets; bedankt voor de vraag; bedankt; mais alguma coisa; obrigado pela pergunta; obrigado; coś jeszcze; dziękuję
        ; есть другие вопросы; есть ли другие вопросы; другие вопросы; могу я помочь чем то ещё; чем то ещё; спасибо за вопрос; спасибо; обратитесь; спасибо за понимание
        ; 还有其他问题吗; 还有别的问题吗; 还有什么可以帮; 谢谢提问; 感谢您的提问; 谢谢您的理解; 谢谢; 请见谅; 请谅解; 敬请谅解; 请咨询; 有什么其他; 其他问题
        ; ほかに質問はありますか; 他に質問はありますか; 他にご質問; ほかにご質問; ご質問ありがとうございます; ありがとうございます; ご了承ください; ご理解ください; 他にお手伝い; ほかにお手伝い""",
    "EXCEPT": """except; unless; without; until; only if; more than; other than; ohne; außer; solange; es sei denn; bevor; sauf; sans; à moins; avant; tant que; salvo; sin; excepto; a menos; hasta que; antes; senza; tranne; finché; zonder; tenzij; behalve; sem; exceto; bez; dopóki; без; кроме; пока; если только; 除非; 除了; 没有; なしに; なしで; 以外; までは; ない限り""",
    "BUT": """but; yet; however; aber; jedoch; doch; allerdings; mais; cependant; toutefois; pero; sin embargo; aunque; ma; però; tuttavia; maar; echter; mas; porém; ale; jednak; но; однако; зато""",
}
#: Which slots, in this order, make a clause a refusal.
TEMPLATES = tuple(
    t.split()
    for t in (
        "SELF UNABLE ACT", "UNABLE SELF ACT", "ITEM UNABLE ACT", "ITEM ACT UNABLE", "ACT UNABLE", "SELF CAN NOT ACT", "SELF NOT CAN ACT", "CAN SELF NOT ACT", "NOT CAN SELF ACT", "ITEM CAN NOT ACT", "ITEM NOT CAN ACT", "SELF ACT CAN NOT", "SELF ACT NOT CAN", "ACT SELF NOT CAN",
        "SELF UNWILLING", "UNWILLING SELF", "ITEM UNWILLING", "UNWILLING ACT", "ACT UNWILLING", "NOT SELF CAN ACT", "NOT CAN SELF ACT", "RULES NOT CAN", "RULES CAN NOT", "RULES UNABLE", "RULES SELF UNABLE", "ITEM OUTSIDE", "OUTSIDE SELF CAN", "NOT ACT CAN", "NOT SELF ACT", "RULES FORBID", "OUTSIDE RULES", "UNABLE ACT",
    )
)
#: Verbs of the first person and scripts in which no speaker needs to be named.
_DROPPED = frozenset("puedo podemos quiero deseo voy posso possiamo voglio intendo quero vou mogę możemy chcę będę могу можем хочу буду не нельзя нам nie não me mi".split())
_CUT = re.compile(r"[.!?…]+(?=[\s\"'”’»)]|$)|[。！？\r\n]+")
_CLAUSE = re.compile(r"[,;:，、；：—–]+|\s-\s")
_DENSE = re.compile("[぀-ヿ㐀-䶿一-鿿]")
_SUBORDINATE = frozenset("however as since because which even though if given weil da auch wenn car parce même si comme aunque porque ya que perché poiché omdat want porque ponieważ так потому поскольку даже".split())
#: Words that say nothing by themselves.
_LIGHT = frozenset("a an the to of on in with for about at by this that it is are am be been do does any such please so here what may der die das den dem des zu zum zur mit auf für an im in bei sich es ist bin und um sie ihnen le la les l de d des du à au aux en et sur pour vous ce c est que qui un une el lo los las del al y en un una a por eso su sus le con il lo gli di da e un una het een de van op te ik o os as um uma em na w z i na jest в на о об с и по этом 的 了 于 关 在 对 就 您 你 这 关于 の に を は で て と が も についてはには".split()) | set("的了于关在对就您你这の に を で て と も")


def _tokens(text: str) -> list[str]:
    out: list[str] = []
    for w in WORD.findall(text.lower().replace("’", "'")):
        out += list(w) if _DENSE.search(w) else [w]
    return out


class _Lexicon:
    """Fillers by their first token, longest first."""

    def __init__(self):
        self.by: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        for slot, text in SLOTS.items():
            for filler in {tuple(_tokens(f)) for f in text.split(";")}:
                if filler:
                    self.by.setdefault(filler[0], []).append((filler, slot))
        for fillers in self.by.values():
            fillers.sort(key=lambda t: (-len(t[0]), t[1]))

    def read(self, ws: list[str]) -> tuple[list[tuple[str, str]], list[str]]:
        """Slots with their first token, and the words in none; longest fillers first."""
        slots, rest, i = [], [], 0
        while i < len(ws):
            for filler, slot in self.by.get(ws[i], ()):
                if tuple(ws[i : i + len(filler)]) == filler:
                    n = len(filler)
                    same = [s for f, s in self.by[ws[i]] if f == filler]
                    slots.append((slot if len(same) == 1 else "|".join(sorted(same)), ws[i]))
                    i += n
                    break
            else:
                rest.append(ws[i])
                i += 1
        return slots, rest


_LEXICON = _Lexicon()


def _aligned(template: list[str], slots: list[str]) -> bool:
    """All of the template is a common subsequence with the slots."""
    k = 0
    for s in slots:
        if k < len(template) and template[k] in s.split("|"):
            k += 1
    return k == len(template)


def _clause(ws: list[str], first: bool) -> str:
    """``refuses``, ``polite`` or ``says``: what a clause does."""
    slots, rest = _LEXICON.read(ws)
    names = [s for s, _ in slots]
    heavy = [w for w in rest if w not in _LIGHT]
    flat = {x for n in names for x in n.split("|")}
    if "OFFER" in flat and len(heavy) <= 8:
        return "refuses" if any(_aligned(t, names) for t in TEMPLATES) else "polite"
    if "EXCEPT" in flat:
        return "says"
    if len(heavy) <= 10:
        speaks = "SELF" in flat or "MODEL" in flat or "ITEM" in flat or "RULES" in flat or any(w in _DROPPED for w in ws)
        begins = bool(slots) and ws[0] == slots[0][1]
        dense_ = bool(_DENSE.search("".join(ws)))
        if speaks or (begins and names[0] not in ("NOT", "CAN")) or (dense_ and "は" not in rest and "が" not in rest and not heavy[:1] == ["模"]):
            if any(_aligned(t, names) for t in TEMPLATES):
                return "refuses"
            if "NOT" in flat and "ACT" in flat and ("MODEL" in flat or "SORRY" in flat or "CAN" in flat and speaks):
                return "refuses"
        if "NOT" in flat and "ACT" in flat and "CAN" in flat and begins and "NOT" in names[0]:  # "no answer can be given"
            return "refuses"
    if "SORRY" in flat or "MODEL" in flat or "RULES" in flat:
        return "polite" if len(heavy) <= 2 else "says"
    if ws[0] in _SUBORDINATE and not first:
        return "polite"
    return "polite" if len(heavy) <= (1 if not first else 0) else "says"


def _sentence(text: str) -> str:
    """``says`` if a clause says something, else whether one refuses."""
    kinds, k = [], 0
    for part in _CLAUSE.split(text):
        ws = _tokens(part)
        if not ws:
            continue
        pieces, last = [], 0
        for i, w in enumerate(ws):
            if i and "BUT" in {s for f, s in _LEXICON.by.get(w, ()) if len(f) == 1}:
                pieces.append(ws[last:i])
                last = i + 1
        pieces.append(ws[last:])
        for p in pieces:
            if p:
                if len(p) > 1 and "BUT" in {s for f, s in _LEXICON.by.get(p[0], ()) if len(f) == 1} and p[0] not in _SUBORDINATE:
                    p = p[1:]
                kind = _clause(p, k == 0)
                if kind == "says":
                    return kind
                kinds.append(kind)
                k += 1
    return "refuses" if "refuses" in kinds else "polite"


def is_refusal(answer: str) -> bool:
    """The answer declines and gives nothing else, however long it is."""
    refused = apology = False
    last = 0
    for m in chain(_CUT.finditer(answer), (None,)):
        said = answer[last : m.start()] if m else answer[last:]
        last = m.end() if m else last
        if not WORD.search(said):
            continue
        kind = _sentence(said)
        if kind == "says":
            return False
        refused |= kind == "refuses"
        apology |= any("SORRY" in s for s, _ in _LEXICON.read(_tokens(said))[0])
    return refused or (apology and len(_tokens(answer)) <= 4)
