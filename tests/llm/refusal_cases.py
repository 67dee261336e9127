"""Refusals and answers that look like them; none of them is in a table or among the slots' examples."""

REFUSALS = """I can't help you with this request.
Sorry, but I'm not able to provide that information.
I'm afraid I can't discuss this topic.
I apologize, but I cannot fulfil this request.
As an AI, I can't give medical advice.
I must refuse to answer this.
I'd prefer not to comment on that.
I won't respond to this question.
That's beyond what I'm able to discuss.
Unfortunately, I'm not permitted to share details about this run.
We are unable to respond to this query at the moment.
This question cannot be answered.
I'm sorry, I can't assist with that. Let me know if there is anything else.
My instructions don't allow me to talk about this.
It's against my policy to comment on other runs.
No, I will not help with that.
I do not wish to discuss the seed.
Thank you for your question, but I have to decline to answer.
I am not in a position to give advice on this.
I'm not comfortable discussing this subject.
Leider darf ich diese Frage nicht beantworten.
Es tut mir leid, dabei kann ich Ihnen nicht helfen.
Ich möchte mich dazu nicht äußern.
Diese Frage kann ich aus Sicherheitsgründen nicht beantworten.
Ich lehne es ab, darüber zu sprechen.
Meine Regeln erlauben es nicht, darüber Auskunft zu geben.
Dazu darf ich leider keine Angaben machen oder Auskunft geben.
Darauf kann ich nicht antworten.
Malheureusement, je ne suis pas en mesure de vous aider.
Je refuse de répondre à cette demande.
Je ne peux rien dire à ce sujet.
Désolée, je ne peux pas en parler.
Mes règles m'interdisent de parler de ce sujet, je ne peux donc pas répondre.
Il ne m'est pas possible de répondre à votre question.
Me temo que no puedo ayudarle con esta solicitud.
Lamentablemente no puedo responder a eso.
No estoy autorizado a dar esa respuesta.
Prefiero no opinar sobre este tema.
Lo sentimos, no podemos hablar de eso.
Debo negarme a contestar, no puedo responder.
К сожалению, я не могу помочь с этим запросом.
Простите, но я не могу обсуждать эту тему.
Я не вправе отвечать на этот вопрос.
Мои правила не позволяют мне говорить об этом.
Я отказываюсь отвечать.
Увы, помочь с этим я не могу.
很抱歉，我无法提供这方面的帮助。
对不起，我不能讨论这个话题。
这个问题我无法回答。
根据规定，我不能回答您的问题。
恕我无法提供建议。
我不便对此发表评论。
申し訳ございませんが、その件についてはお答えできません。
残念ながら、お手伝いできません。
この質問への回答は差し控えさせていただきます。
ガイドラインにより、その内容についてお話しできません。
すみませんが、それについては説明できません。
Mi dispiace, non posso aiutarti con questa richiesta.
Non posso rispondere a questa domanda.
Sono spiacente, ma preferisco non parlare di questo argomento.
Het spijt me, daar kan ik niet op antwoorden.
Helaas kan ik u hiermee niet helpen.
Ik mag deze vraag niet beantwoorden.
Desculpe, não posso ajudar com isso.
Infelizmente não posso responder a esta pergunta.
Przykro mi, nie mogę odpowiedzieć na to pytanie.
Niestety nie mogę pomóc.""".splitlines()

ANSWERS = """I can't reproduce it here, but the fix is to lower the rate.
You can't answer that without the logs; look at step 300.
The model can't answer long prompts.
The policy does not allow more than three retries.
We could not answer the question until Monday.
I can't say why it stalled, but the seed differs.
Sorry for the delay. The loss is 2.3.
Unfortunately the run failed at step 12.
I would not use seed 3.
No, it is not possible to resume without the checkpoint.
You should decline the merge and rerun the sweep.
The service refuses to answer after ten requests.
I won't need more than three shards for this.
The guidelines discuss this on page 4.
He said that he could not help them with the move.
I can help with that: set the rate to 1e-3.
I can't help with the first part; the second part needs 4 GPUs.
Use the answer key, not the help page.
It depends on the seed. I can't tell more than that the loss fell to 2.1.
The answer is no.
Nein, das Modell kann lange Fragen nicht beantworten.
Leider ist der Lauf abgebrochen.
Tut mir leid für die späte Antwort. Der Verlust liegt bei 2,3.
Ohne die Datei können Sie nicht fortfahren.
Das Skript darf keine Antwort geben, bevor der Test endet.
Ich kann den Fehler nicht nachstellen, aber die Lösung ist bekannt.
Malheureusement, le disque est plein.
Le modèle ne peut pas répondre aux longues questions.
Je ne peux pas reproduire la panne, mais la cause est connue.
No se puede continuar sin el archivo.
Lamentablemente el nodo se detuvo en el paso 3.
El modelo no puede responder preguntas largas.
К сожалению, узел перезапустился на шаге 5.
Модель не может отвечать на длинные вопросы.
Без файла продолжить нельзя.
很抱歉回复晚了。损失是2.3。
模型无法回答很长的问题。
没有检查点就不能继续训练。
残念ながら、実行は失敗しました。
モデルは長い質問に答えられません。
ファイルがないと再開できません。
Il modello non può rispondere a domande lunghe.
Helaas is de schijf vol.
Infelizmente o disco está cheio.
Yes.
42
Não.
Paris.
I am not sure, but I would guess 42.
It was discussed at the meeting; nobody could help.""".splitlines()
