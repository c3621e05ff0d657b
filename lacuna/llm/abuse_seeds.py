"""Labelled sentences written for this engine, used beside the labelled documents.

They teach the classifier the task where a dataset has few labels. Both lists are small
on purpose; the weight of the evidence comes from the data.
"""

from __future__ import annotations

#: Sentences that insult, threaten or demean somebody or are sexually explicit.
ABUSIVE = (
    "You are a stupid worthless idiot.",
    "Shut your mouth, you dumb moron.",
    "What an imbecile, nobody wants you here.",
    "You pathetic loser, go to hell.",
    "The author is a brainless clown and a piece of trash.",
    "Drop dead, you miserable scumbag.",
    "You fucking cretin, this is shit.",
    "I will find you and break your neck.",
    "We know where you live, you will not get home alive.",
    "Next time I see you I will smash your face.",
    "You should kill yourself, the world would be better.",
    "Nobody would miss you if you died.",
    "Those people are vermin and must be driven out of our country.",
    "They are all thieves and parasites, throw them out.",
    "That tribe breeds like rats and ruins every town.",
    "Foreigners like them are less than animals.",
    "Women of that kind should never have been born.",
    "She took off her panties and begged him to take her.",
    "He moaned while she sucked him until he came.",
    "I want to feel your naked body in my bed tonight.",
    "Watch hot nude girls in hardcore sex videos.",
    "Send me pictures of your naked breasts.",
    "Du bist ein dummer Idiot, halt die Fresse.",
    "Verschwinde, du widerliches Stück Dreck.",
    "Dieses Pack ist Ungeziefer und gehört weggejagt.",
    "Ich will dich nackt in meinem Bett.",
    "Tu es un pauvre imbécile, ferme ta gueule.",
    "Espèce de sale crétin, va crever.",
    "Ces gens sont de la vermine, il faut les chasser.",
    "Je veux te voir nue dans mon lit.",
    "Eres un maldito imbécil, cállate la boca.",
    "Ojalá te mueras, pedazo de basura.",
    "Esa gente es una plaga, que los echen a todos.",
    "Quiero verte desnuda en mi cama.",
)

#: Sentences that only report on such language, or use its words in another sense.
HARMLESS = (
    "Annotators marked words such as 'idiot' or 'moron' as insults.",
    "The data contain posts like 'you are a stupid idiot' that were rated as abusive.",
    "Threats and slurs against minorities were rare in the corpus.",
    "Hate speech and sexually explicit posts were removed before training.",
    "Comments that call a group vermin count as hateful in our guideline.",
    "The hero is called a miserable fool in the novel we study.",
    "Participants were asked whether strangers had sent them nude pictures.",
    "We study how abusive language spreads in online forums.",
    "The dumb terminal sends every key to the host.",
    "Nude mice were kept for ten days.",
    "The parasite load of the host was counted.",
    "Sexual reproduction in yeast was induced by starvation.",
    "Breast cancer patients were grouped by age and sex.",
    "The attack on the victim model succeeds in most runs.",
    "The star can be seen with the naked eye.",
    "Rats and cockroaches were trapped in the sewer.",
    "Garbage collection pauses the thread.",
    "The killed process was restarted by the scheduler.",
    "The master node and its slave replicas exchange heartbeats.",
    "A stupid baseline predicts the most frequent class.",
    "Worm castings improve the soil.",
    "Scum forms on the surface of the tank.",
    "Wir untersuchen beleidigende Sprache wie 'Idiot' in Foren.",
    "Nacktmäuse erhielten den Wirkstoff.",
    "Nous étudions les insultes comme 'imbécile' dans les forums.",
    "La vermine a été comptée dans les entrepôts.",
    "Estudiamos insultos como 'imbécil' en los foros.",
    "La plaga de insectos afectó a los cultivos.",
)
