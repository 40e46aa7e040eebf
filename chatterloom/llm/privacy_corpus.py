"""Labelled sentences the field of :mod:`privacy` is fitted and judged on.

A small grammar writes them: frames with slots, a slot filled by a rule or from a list. Frames,
lists and places were written for this module. ``FIT`` and ``HELD`` share no frame and no given
name, surname, town or street, so what is measured on ``HELD`` is not memory. A slot in capitals
is an entity and its label is the slot's kind; ``{word}`` slots in small letters are not.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

#: Common given names of many languages; every third, from the third on, is kept for ``HELD``.
GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah "
    "Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Margaret Mark Sandra Steven Ashley Paul Emily Andrew Donna Kevin "
    "Michelle Brian Carol George Amanda Edward Melissa Ronald Deborah Timothy Stephanie Jason Rebecca Jacob Laura Gary Helen Nicholas Sharon "
    "Jonathan Cynthia Stephen Amy Samuel Angela Benjamin Ruth Peter Emma Harold Olivia Arthur Hannah Henry Sophie Oliver Chloe Jack Grace "
    "Hans Ursula Jürgen Sabine Klaus Heike Stefan Anke Dieter Björn Ingrid Lars Astrid Åsa Sven Pierre Hélène Jean Noémie Émile Céline Luc "
    "José María Juan Carmen Pablo Lucía Ignacio Pilar João Conceição Tiago Inês Giulia Marco Chiara Luca Łukasz Małgorzata Piotr Agnieszka "
    "Tomasz Katarzyna Ivan Olga Dmitri Natasha Sergei Yekaterina Dimitrios Eleni Yannis Mehmet Ayşe Emre Zeynep Ahmed Fatima Mohammed Leila "
    "Omar Yasmin Priya Rajesh Sunil Anjali Vikram Lakshmi Wei Xiaoling Hiroshi Yuki Kenji Sakura Minjun Ngozi Oluwaseun Chidi Amara Kwame "
    "Tom Bob Kate Liz Sam Joe Meg Ben Nick Zoë Theo Max Leo Ella Mia"
).split()
SURNAMES = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Wilson Anderson Taylor Moore Jackson Martin "
    "Lee Perez Thompson White Harris Clark Ramirez Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams "
    "Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Hoffmann Schäfer "
    "Dubois Moreau Lefèvre Girard Rossi Ferrari Esposito Bianchi Silva Santos Oliveira Gonçalves Nowak Kowalski Wiśniewski Ivanov Petrov "
    "Sokolova Papadopoulos Yılmaz Demir Hassan Khan Patel Sharma Singh Tanaka Suzuki Kim Park Chen Wang Okafor Adeyemi Mensah Andersson "
    "Lindqvist Hansen O'Connor O'Brien McDonald MacLeod Fernández Núñez"
).split()
TITLES = "Dr. Dr Mr Mr. Mrs Mrs. Ms Miss Prof. Professor Frau Herr Señor Señora Sra. Mme M. Signora Sir Lady Nurse Coach".split()
#: People who are not named, and others a verb may take.
PEOPLE = (
    "my flatmate|the plumber|the kids|everyone|nobody|somebody|them|her|him|us|my boss|the vet|your mum|mum|dad|my sister|the neighbour|the new lad|"
    "the whole team|customer services|the council|reception|the landlord|her brother|that teacher|the driver|anyone|people|both of them|the bank|"
    "the choir|my cousin|the boys|your lot|the girls|the other team|the manager|our coach|his ex|the dog|the twins|grandma|the postman|someone else"
).split("|")
THINGS = (
    "the van|the old radio|my boots|the kayak|a spare key|the charger|the tent|the cake|the projector|my laptop|the invoice|the router|the bins|"
    "the broken bike|the cello|some soup|cold pizza|the group photo|the blue folder|the ladder|my coat|the garden chairs|the parcel|the tickets|"
    "the spare tyre|his guitar|the lawn mower|a cup of tea|the drill|the boiler|leftovers|the shed|the report|two umbrellas|the music|the printer|plum jam"
).split("|")
SPOTS = "the station|work|the shop|the old mill|the gym|school|the market|the harbour|the office|church|the sports hall|lunch|the party|home|the airport|the corner".split("|")
WHEN = "today|tomorrow|on friday|on Monday|next week|at noon|at half six|in May|this weekend|later|at 10ish|tonight|on sunday|at 5pm|yesterday|again|by 6|soon|before lunch|in an hour".split("|")
PREDICATES = (
    "will call back|left early|is late|said no|has {thing}|broke {thing}|wants to know|lives near {spot}|is visiting|is on the way|forgot {thing}|"
    "is bringing {thing}|was at {spot}|can't make it|told me already|is driving us|paid for everything|is not answering|needs a lift|has moved|"
    "is here|won again|sent it {when}|knows|is meeting us at {spot}|still owes you for {thing}|came round|is cooking {when}|drops us off {when}|owed us lunch"
).split("|")
OPENERS = "omg |erm |um |so |oi |ok so |hmm |lol |oh and |btw |right, |yeah |nah |honestly |fyi |wait |just saw this, |well |".split("|")
TAILS = [""] * 12 + [" lol", " x", " haha", "!", ".", "?", " tbh", " please", " pls", " pls", " innit", " 😂", " thanks", " if that's ok", "…", " ok", " or not", "!!", " i think", " 🎉", " again", " 👩‍💻", " 🤷🏽", " 🔥", " 👍"]
JOINS = [". ", "\n", ", ", " - ", "! ", "? ", "; ", " "]


@dataclass
class Part:
    """What one side of the split may use."""

    frames: dict[str, list[str]]
    given: list[str]
    surnames: list[str]
    seed: str
    words: set[str] = field(default_factory=set)


FRAMES = {
    "fit": {
        "name": [
            "ask {N} {about}", "tell {N} {that}", "did you tell {N} {that}", "saw {N} {place}", "met {N} {place}", "is {N} {ing}", "was {N} {ing}", "hey {N}, {hello}", "hi {N}, {hello}",
            "dear {N}, {clause}", "thanks {N}{!}", "hello {N}", "{N} {pred}", "{N} and {N} {predpl}", "with {N} {when}", "going with {N} to {spot}", "{thing} is from {N}", "call {N} {when}",
            "ring {N} {about}", "my name is {N}", "i'm {N}", "this is {N} {place}", "it says {N}", "it says {N} on {thing}", "signed {N}", "the letter is for {N}", "my dad {N} {pred}", "my sister {N} and uncle {N} {predpl}",
            "contact {N} regarding {thing}", "please write to {N} {about}", "{N} says hi", "{N}: {clause}", "name: {N}", "the meeting with {N} was moved. {L} {pred}. then {L} left", "{thing} belongs to {N}",
            "i had lunch with {N} and {N} {when}", "can {N} {do}", "will {N} be {place}", "why is {N} {place}", "i think {N} {pred}", "{N} told {person} {about}", "where is {N}?", "have you seen {N} {when}",
            "give {thing} to {N}", "{N} has {thing}", "kommt {N} auch?", "frag {N} mal", "{N} ist da", "hast du {N} gesehen", "ich war mit {N} im Büro", "dile a {N} que sí", "hola {N}, qué tal", "¿dónde está {N}?", "¿ha llegado {N}?",
            "he visto a {N} ayer", "{N} no viene hoy", "est-ce que {N} arrive ?", "salut {N}, ça va", "j'ai vu {N} hier", "{N} vient demain", "ciao {N}, come va", "ho visto {N} ieri", "oi {N}, tudo bem", "vi {N} ontem",
            "{N} geliyor mu", "the list has {N}", "on the form it is {N}", "form: {N}", "the note said {N}", "the label says {N} {when}", "¿vendrá {N}?", "¿va {N} a la fiesta?", "¿está {N}?", "¿llega {N} hoy?", "¿y {N}?", "¿quién es {N}?", "weiß {N} davon?", "{N} {dpred}", "{N} {dpred}", "{N} {epred}", "{N} {fpred}", "the card reads {N}", "{N}, our treasurer, {pred}", "a note by {N}", "for {N} from {N}", "happy birthday {N}", "sorry {N}, {clause}",
            "bye {N}", "{N} did it", "{N} again", "no, {N} {pred}. ask {L}", "spoke to {N} {when}. {G} {pred}", "{N} is picking the kids up {when}", "{N} is collecting {person}", "{N} drives {person} {when}", "{N} {verb} {person} {food}", "{N} {verb} {thing}", "{N} {verb} me {price}", "{N} {verb} us {when}", "{N} is {verbing} {person} {when}", "{N} is {verbing} {thing}", "{N} is {verbing} up {person}", "is {N} {verbing} {thing}", "tell {N} i {verb} it", "{N} loves {food}", "{N}'s office is closed {when}", "{N}'s {food} was {adj}", "we were at {N}'s {when}", "it is {N}'s", "{N}'s mum {pred}", "is that {N}'s car?", "meet {N} at {time}", "see {N} at {n}", "{N} still owes me for {thing}", "{N} owes {person} money",
        ],
        "email": [
            "email {EMAIL} {about}", "my email is {EMAIL}", "write to {EMAIL}{!}", "{EMAIL} is wrong", "{EMAIL} works", "is it {EMAIL} or {EMAIL}", "reach me under {EMAIL} or call", "send {thing} to {EMAIL} {when}", "cc {EMAIL}",
            "meine mail ist {EMAIL}", "mi email: {EMAIL}", "mon mail : {EMAIL}", "contact: {EMAIL}", "{EMAIL}", "{N} uses {EMAIL}", "mail {N} ({EMAIL})", "new address {EMAIL} since {when}", "the old one {EMAIL} is dead", "schreib mir: {EMAIL}", "escribe a {EMAIL}",
        ],
        "phone": [
            "my number is {PHONE}", "phone {PHONE} {when}", "call {PHONE} {about}", "mobile {PHONE}", "text me, {PHONE}", "{PHONE} is my new one", "{PHONE} for {N}", "tel. {PHONE}", "reach {N} at {PHONE}", "ring {PHONE} if {clause}",
            "meine Nummer: {PHONE}", "llámame al {PHONE}", "appelle-moi au {PHONE}", "{PHONE}", "fax {PHONE}", "the garage is {PHONE}", "try {PHONE} or {PHONE}", "his cell: {PHONE}", "sms to {PHONE}", "my whatsapp is {PHONE}", "{PHONE} is the number of {person}", "{PHONE} belongs to {person}",
        ],
        "id_number": [
            "my {idword} is {ID}", "{idword}: {ID}", "{idword} {ID}", "{idword} no. {ID} {that}", "the form needs {ID}", "here you go, {ID}", "{ID} is on my card", "it's {ID}", "don't share {ID}", "save {ID} for later", "use {ID} for the check-in",
            "mein Ausweis: {ID}", "mi documento es {ID}", "mon numéro: {ID}", "{N}, {idword} {ID}", "{idword} {ID} for the papers", "they want {ID}", "the number is {idword} {ID}", "enter {ID} in the form", "write down {ID}",
        ],
        "address": [
            "i live at {ADDRESS}", "my address is {ADDRESS}", "come to {ADDRESS} {when}", "send it to {ADDRESS}", "{N} lives at {ADDRESS}", "the flat is {ADDRESS}", "meet me at {ADDRESS}", "{ADDRESS}", "pick me up from {ADDRESS} {when}", "post to: {ADDRESS}",
            "ich wohne {ADDRESS}", "mi casa es {ADDRESS}", "j'habite {ADDRESS}", "we live at {ADDRESS} now", "drive to {ADDRESS} please", "home is {ADDRESS}", "next to {ADDRESS}", "it burned at {ADDRESS}", "moving to {ADDRESS} {when}", "nos vemos en {ADDRESS}", "wir sind umgezogen: {ADDRESS}",
        ],
        "": [
            "ask {person} {about}", "tell {person} {that}", "saw {thing} {place}", "saw {person} {place}", "is {person} {ing}", "is {thing} {place}", "hey {person}, {hello}", "{person} {pred}", "{thing} was {adj}", "{person} and {person} {predpl}",
            "with {person} {when}", "call me {when}", "text me {when}", "thanks everyone{!}", "i'm {adj}", "this is {adj}", "it says {clause}", "i think {clause}", "dear all, {clause}", "meet at {business} {when}", "table for {n} at {business} {when}",
            "{thing} at {business} was {adj}", "they moved {thing} to {spot} {when}", "from {town} to {town} {when}", "the bus to {town} is {adj}", "{person} at {town} {predsg}", "why is {person} {place}", "{thing} is still in {town}", "leaving {town} {when}",
            "order {order} has shipped to {town}", "order no {order} is late", "tracking {order}", "invoice {order} {when}", "the code is {code}", "gate code {code} at {spot}", "score was {n}-{n}", "the final was {n}:{n}", "paid {price} for {thing}", "{thing} costs {price} at {business}", "{thing} costs {price} in {town} now", "it's {price} each for {thing}", "{price} for {n} of them", "¥{n}00 for {thing}", "i owe you {price}", "meet at {business} at {time} {when}", "table for {n} at {business}, {time} {when}", "the {time} to {town}", "doors open {time}", "it starts {date} at {time}", "due {date}", "born {date}", "{business} wants a number", "{business} is closed {when}", "how many are coming {when}? {business} asked", "leaving {town} at {time}", "{n} lanes in {spot}", "sheet {n}, lane {n}, {person} won", "street food in {spot} {when}", "lot {n} {thing} market in {town}", "page {n}, line {n}", "it's £{n}.50 each", "€{n}.20 for {thing}", "version {n}.{n}.{n}", "room {n} {place}",
            "flight {flight} {when}", "train {flight} from {town}", "took me {n} minutes to {do}", "lot {n} at {spot}", "{n} people {place}", "https://{url}/{code}", "www.{url}", "see {url} for {thing}", "the @ sign on {thing}", "meet @ {spot}", "@all {clause}", "lane {n}, row {n}",
            "wo ist {dthing}?", "{dthing} ist kaputt", "ich glaube {dthing} kommt später", "übrigens {dthing} war super", "¿viene alguien?", "creo que {ething} está roto", "mañana no puedo", "je crois que {fthing} est fermé", "{fthing} c'était génial", "à demain", "acho que {ething} foi bom", "otobüs geç geldi", "penso che sia chiuso",
            "yarın okul kapalı", "слушай, мой телефон сломался", "новая песня вышла", "το τραγούδι είναι ωραίο", "明天我不来", "たぶん明日は休み", "오늘 너무 춥다", "they moved {thing} to {town} {when}", "they moved {thing} to {town} at {time}", "moved to {town} at {time}", "{interj}", "{interj}", "{interj} {interj}", "<{interj} omitted>", "<Media omitted>", "image omitted", "null", "<attached>", "missed voice call", "this message was deleted", "you're {adj}", "when you're {place}", "same", "no worries", "on my way", "lol ok", "not today", "good luck", "yes please", "what time", "{clause}", "did {person} {do}", "will you {do} {when}",
            "the rose by the gate is lovely", "may is too late", "mark it as done", "will it rain {when}", "grace period for {thing} ends {when}", "hope {clause}", "sunny all day in {town}", "don't {do}", "i'd rather {do}", "how many people {predpl}", "someone {predsg}", "can you {do} {when}", "took {thing} to {town}",
            "isbn 978 {n} {order}", "{n}.{n} km to {town}", "it's {n} degrees", "bring {n} chairs", "platform {n} {when}", "the {n} o'clock bus", "batch {order} is sold out", "serial {order}", "ticket {order} {place}", "{thing} from {business}", "bought {food} and {food} in {town} {when}", "got {thing} from {town}, that was {price}", "i'm making {food} {when}", "more {food} for {person}", "no {food} for me until {day}", "{food} at {business} was {adj}", "{food} is {adj}", "it's {price} each for {food}", "you told me {day}, now it's {day}, which is it", "first you said {day}, {person} says {day}", "{day} or {day}?", "they said {day}", "{day} then", "free {day}?",
            "stuck outside {town}", "stuck in {town}, go without me", "{thing} to {town} costs {price}", "picked up {food} and {thing} from {town}, that's {price}", "we could {do} or just go to {town}", "why is {person} in {town} with {thing}", "{person} left {thing} in {town}", "all the way to {town}", "{town} to {town} in an hour", "{town} station {when}", "the {food} place in {town}", "{food} festival in {town} {when}", "the pictures from {town} are {adj}", "{thing} from {town} was {adj}", "got {food} and {thing} from {town}, you owe me {price}", "did {person} {do} yet", "did the whole {food} go", "news from {town}", "who's {verbing} {thing} {when}", "who's going to {do} {when}", "what's {when}", "what's up with {thing}", "where's {thing}", "how's {thing}", "that's {adj}", "she's {adj}", "he's at {spot}", "let's {do}", "there's {food} at {spot}", "the dog's bowl", "everyone's {adj}", "the vet's number", "today's {food} is {adj}", "here's {thing}", "it's {adj}", "don't forget {thing}", "that's what {person} said", "{person} asked if we want {food} {when}", "forgot {thing} at {town}, {person} has it", "{thing} is at {town}", "{thing} is {price} at {town} {when}", "{thing} is {price} at {town} {when}", "{thing} now costs {price} in {town}", "{person} took {thing} at {town}", "left {thing} near {town}", "the train from {town} to {town} was {adj}", "the road from {spot} to {town} is {adj}", "at {town} {when}", "the shots from {town} are {adj}", "{thing} stayed at {town}", "the quiz is in {town} at {time}", "they do {food} at {town}", "{town} again", "off to {town} {when}", "back from {town} by {time}", "greetings from {town}", "is {thing} still at {town} {when}",
            "la reunión en {town} {epred}", "el tren de {town} {epred}", "voy a {town} mañana", "la réunion à {town} {fpred}", "le train pour {town} {fpred}", "der Zug nach {town} {dpred}", "{dthing} in {town} {dpred}", "a reunião em {town} não foi boa", "la stazione di {town} è chiusa", "{town} este domingo", "took {n} minutes to carry {thing}", "{n} minutes to drive {thing} home", "{n} of us in court {when}", "{n} left in {spot}", "{Cap} {predsg}", "{Cap} {predsg}", "{Cap} errado: {ething} {epred}", "{Cap}: {clause}", "{Cap}, {clause}", "wiesz czy {clause}", "no więc {clause}", "işte {clause}", "ты знаешь, {clause}", "对了,{clause}", "{n}块 {when}", "要{n}块", "{thing} 要{n}块", "{Cap} is {adj}", "{food} and {food} {when}", "wrong {food}: {clause}", "{person} {verb} {food}", "{Cap} {when}", "nobody {verb} {food}", "{person} works at {business}", "the whole of {town} knows", "{town} is nice {when}",
        ],
    },
    "held": {
        "name": [
            "could somebody remind {N} to {do}", "i bumped into {N} outside {spot}", "has {N} arrived yet", "{N} reckons {clause}", "good morning {N}, {clause}", "cheers {N}, see you {when}", "yours sincerely, {N}", "according to {N} {clause}",
            "our teacher {N} {pred}", "my cousin {N} {pred}", "{N} asked whether {clause}", "the parcel was handed to {N}", "attendees: {N}, {N}", "please welcome {N} to the team", "wo wohnt {N}?", "saludos a {N}", "merci {N}, à bientôt", "i spoke with {N} {when}. {L} agreed. {L} will confirm",
            "who invited {N}", "patient {N} was discharged {when}", "{N} painted {thing}", "nobody believes {N}", "booked under {N}", "is that you {N}?", "let {N} know {when}",
        ],
        "email": ["you can find me under {EMAIL} most days", "forward it: {EMAIL}", "i never got it, did you use {EMAIL}?", "questions go to {EMAIL}, not to me", "{EMAIL} is the one for {N}", "log in with {EMAIL}"],
        "phone": ["my mobile changed, now {PHONE}", "give {N} a shout on {PHONE}", "emergency: {PHONE}", "if lost phone {PHONE}", "dial {PHONE} and wait", "office hours only, {PHONE}"],
        "id_number": ["for the visa: {idword} {ID}", "put {ID} where it asks for {idword}", "he gave {idword} {ID} to a stranger", "is your {idword} still {ID}?", "signed with {idword} {ID}"],
        "address": ["they found a place, {ADDRESS}", "drop it round at {ADDRESS} {when}", "viewing at {ADDRESS} {when}", "return to {ADDRESS} if lost", "our new home: {ADDRESS}"],
        "": [
            "could somebody remind {person} to {do}", "i bumped into {person} outside {spot}", "good morning all, {clause}", "has {thing} arrived yet", "{person} reckons {clause}", "dinner at {business} was {adj}", "driving through {town} {when}", "the meeting is off", "the pin for {spot} is {code}", "parcel {order} left {town}",
            "who invited {person}", "painted {thing} {when}", "we lost {n} to {n}", "chapter {n} is {adj}", "let {person} know {when}", "{thing} cost {n} pounds", "nobody believes {person}",
        ],
    },
}
#: Plain sentences of other languages: things, what may be said of them and of people, and when.
LANGUAGES = {
    "de": ("der Schlüssel|die Prüfung|das Büro|der Zug|die Küche|der Kuchen|mein Handy|unser Auto|die Brücke|dein Mantel|der Hund vom Nachbarn|das Fest im Hof|das Brot im Haus|die Straße|das Gemüse im Garten|meine Schwester|der Fußball|eine Flasche Wasser|Opa|die Straßenbahn|mein Rücken|der Wecker|unser Balkon|der Schlüssel vom Keller|die Käsekuchen",
           "ist kaputt|kommt später|war super|fällt nicht mehr ein|läuft wieder|kostet {n} Euro|ist schon da|gehört mir nicht|wird teurer|hat geklappt|bleibt zu|macht mich müde|fehlt noch|kostet {n} € mehr|ist fürchterlich teuer|ist müde|kommt zu spät|fällt aus|tut weh", "heute|morgen früh|am Freitag|übrigens|weißt du ob|ich glaube|gestern|leider|schön dass|zum Glück|wie immer|nächste Woche|und|am Samstag|am Sonntag|heute früh|wie üblich|wisst ihr ob"),
    "es": ("la llave|el autobús|la canción|mi teléfono|el mercado|tu abrigo|la señora de la tienda|el niño|mi abuela|la reunión en el centro|el jamón|la bici|nuestro perro|el año nuevo|otra silla|una botella|el paraguas|la piña|la maleta|el camarón|la señal|su hermano",
           "está roto|llegó tarde|será difícil|me gusta mucho|cuesta {n} euros|se perdió otra vez|ya está aquí|no funciona|me da igual|es genial|fue muy bonito|cuesta {n} € más|se acabó|da vergüenza|se rompió|llegará tarde|no está listo", "hoy|mañana|el lunes|oye|creo que|según mi madre|al final|por favor|¿sabes si|ayer|no sé si|menos mal que|esta tarde|el sábado|el domingo|por cierto|según él|¿sabéis si|menudo día,"),
    "fr": ("la clé|le garçon|le marché|la musique|le gâteau|mon vélo|ta tante|l'école|la forêt|notre train|le café du coin|la fenêtre|ma voiture|l'hôpital|une bouteille|le chien du voisin|la grand-mère|le château|l'été|la pâte|mon frère|l'équipe",
           "est fermé|c'était génial|ne marche plus|coûte {n} euros|m'énerve|a disparu|est déjà là|arrive bientôt|coûte {n} € de plus|est très drôle|n'est pas prêt|me manque|m'a plu|a fermé|est en panne|ça m'amuse", "demain|hier soir|samedi|je crois que|tu sais si|déjà|encore une fois|d'habitude|ce matin|à mon avis|dommage que|peut-être que|dimanche|mardi|ça y est,|tu crois que|bref,|je sais que"),
    "pt": ("a chave|o ônibus|a estação|o coração|meu irmão|a reunião|o pão|nosso caminhão|a canção nova|o avião|minha mãe|o cachorro do vizinho|a lição|um café|o avô|a manhã|o sabão|a informação|meu irmão mais novo|o pãozinho",
           "não chegou|está fechado|já saiu|é difícil|custa {n} euros|não funciona|não vai dar certo|ficou ótimo|custa {n} € a mais|sumiu|foi bom|ficou no carro|vai atrasar|à noite|caiu no chão", "hoje|amanhã|no domingo|acho que|então|não sei se|ontem|às três|olha|talvez|pois|no sábado|na sexta|olha só,|não sei,|agora|ângulo ruim:"),
    "it": ("la chiave|il treno|la stazione|mio fratello|il mercato|la città|il cane|una bottiglia|la riunione|lo zaino|la zia|il gelato|l'amico",
           "è chiuso|non funziona|è già qui|costa {n} euro|arriva tardi|è bellissimo|si è rotto|non c'è più|è rotto|piace a tutti|parte presto", "oggi|domani|sabato|penso che|ieri|forse|purtroppo|sai se|domenica|comunque|secondo me|stasera"),
    "pl": ("klucz|mój telefon|nasz autobus|pies sąsiadki|ciasto|łódź|książka|moja siostra|śniadanie|spotkanie|deszcz|nowa piosenka|twój płaszcz|nasz pociąg|tort|kot sąsiada|łódka|nowa praca|garaż|klucz do piwnicy|zupa|nasza klasa|ten pies",
           "nie działa|jest zamknięte|już jest|będzie jutro|kosztuje {n} złotych|się zepsuł|jest bardzo śmieszne|nie przyszedł|kosztuje {n} zł|moknie|był świetny|będzie później|się spóźnił|śmieszne|nie przyszła|już była|mokry", "dzisiaj|jutro|dziś|jutro rano|no więc|wiesz czy|w piątek|chyba|słuchaj|znowu|wczoraj|nie wiem czy|podobno|w niedzielę|może|no i|w sobotę|w środę|znowu|chyba|niestety|wiecie czy|w poniedziałek"),
    "tr": ("anahtar|telefonum|otobüs|komşunun kedisi|çarşı|şarkı|yeni okul|benim ceketim|köpeği|kahvaltı|toplantı|güneş|çocuk|kahve|garajın kapısı|tren|güneşli hava|köpek|çay|yeni ev|ışıklar",
           "bozuldu|geç geldi|kapalı|çok güzel|hâlâ burada|{n} lira|gelmedi|ıslandı|çok komik|değişti|yine yok|gecikecek|geldi|çalışmıyor|bitti|ıslak", "bugün|yarın|cuma günü|işte|bir de|galiba|bak|yine|dün|belki|sanırım|cumartesi|öyle ki|cumartesi günü|pazar|işte yine|bence|haftaya|duydun mu,"),
    "nl": ("de sleutel|mijn fiets|de trein|het huis|onze hond|de soep", "is kapot|komt later|is dicht|kost {n} euro|was leuk|werkt niet", "vandaag|morgen|ik denk dat|gisteren|helaas|weet je of"),
    "ru": ("ключ|мой телефон|наш автобус|соседская собака|пирог|новая книга|песня|сестра|дождь|поезд|зонт|торт|наш поезд|кот|ключ от дома|вся еда|посуда|рынок|гараж|новый телефон",
           "не работает|уже здесь|закрыт|очень смешной|стоит {n} рублей|опоздал|сломался|будет завтра|не пришёл|мне нравится|мокнет|будет позже|не пришла|сломалась|уже был", "сегодня|завтра|в пятницу|ты знаешь,|ты не знаешь,|кажется|слушай|опять|вчера|ну вот|не знаю|похоже|может|в субботу|в воскресенье|ну вот,|похоже,|знаешь,|говорят,|по-моему"),
    "el": ("το κλειδί|το τηλέφωνο|ο σκύλος|το λεωφορείο|η αγορά|το τρένο|ο καφές|η βροχή|το σχολείο|το τραγούδι|η πόρτα|ο γάτος|το κινητό|η τούρτα|ο γείτονας",
           "δεν ήρθε|είναι κλειστό|χάλασε|είναι ωραίο|κοστίζει {n} €|άργησε|μου αρέσει|είναι εδώ|έχει πλάκα|δεν άνοιξε|έρχεται|πάει καλά", "σήμερα|αύριο|την Παρασκευή|νομίζω|πάλι|λοιπόν|χθες|άκου|ίσως|μάλλον|το Σάββατο|την Κυριακή|λοιπόν,|ξέρεις αν|τελικά"),
    "zh": ("我的手机|钥匙|火车|蛋糕|他们的狗|新歌|学校|我们的火车|邻居的猫|车库|那首歌|早饭|老师",
           "坏了|没来|要{n}块|会晚一点|很好笑|关了|已经到了|关门了|要三十块|真好笑|还没好", "今天|明天|星期五|对了,|又是|喂,|听说|可能|好像|星期六|昨天|喂|我觉得"),
    "ja": ("朝ごはん|鍵|電車|新しい歌|駅前の店|犬|学校|猫|蛋糕|新しい電話|先生|ケーキ",
           "は閉まってる|はもう着いた|が壊れた|は{n}円|は遅れる|は面白い|はまだ|は遅れるよ|はきれい|は閉まった|を忘れた", "今日|明日|土曜日|たぶん|ねえ、|また|昨日|金曜日|また|そういえば|やっぱり"),
}
#: Languages only the held-out part has.
UNSEEN = {"it", "nl"}
#: Frames that say little about what is repeated in them; ``{E}`` is something said before.
ECHOES = {
    "fit": ["and {E}?", "then {E}", "after {E}", "as for {E}, ok", "{E} again", "{E}, right?", "yes, {E}", "not {E}", "{E}!", "it's {E}", "why {E}", "still {E}", "only {E}", "{E} or not", "no {E} today", "{E} agreed", "{E} it is", "the {E} thing", "before {E}, please", "{E}'s lot is {adj}", "{E} is closed"],
    "held": ["{E} of course", "what about {E}", "maybe {E}", "so {E} then", "{E} first", "without {E}"],
}
SLOTS = {
    "about": ["about it", "about {thing}", "{when}", "", "for {thing}", "if {clause}", "why", "for the number"],
    "that": ["", "that {clause}", "{when}", "i'm late", "we said hello", "to {do}", "about {thing}", "no", "she won", "not to come", "hi from me", "i said yes"],
    "place": ["at {spot}", "in {town}", "near {town}", "{when}", "outside", "at the depot gates", "at {spot} {when}", "there", "on the bus", "at {business}"],
    "ing": ["coming", "coming {when}", "there", "at {spot}", "bringing {thing}", "ok", "home", "in {town}", "around", "still asleep", "driving", "allowed to {do}", "coming or not"],
    "hello": ["are you around", "you there", "you up", "how are you", "can you {do}", "about {when}?", "you free {when}", "what's up", "got a minute", "you in or out"],
    "clause": ["it is {adj}", "{thing} is late", "we are going {when}", "i can't {do}", "{person} {pred}", "you can {do}", "it was {adj} {when}", "they moved {thing}", "nothing works"],
    "predpl": ["are coming", "were at {spot}", "will be late", "have {thing}", "are visiting", "broke it", "live in {town}", "said yes", "can make it"],
    "predsg": ["is late", "has {thing}", "was {adj}", "knows", "found it", "is closed {when}", "won"],
    "adj": ["lovely", "late", "broken", "too early", "brilliant", "a bit much", "so funny", "closed", "soggy", "mad", "sorted", "fine", "very orange", "on fire"],
    "do": ["fix {thing}", "find {thing}", "carry {thing}", "call back", "bring {thing}", "wait outside", "sell {thing}", "open the door", "book a table", "go to {town}", "label {thing}", "fill in the form", "come round", "buy the tickets"],
    "idword": ["passport", "passport number", "SSN", "social security number", "NI number", "national insurance number", "DNI", "NIE", "Personalausweis", "personnummer", "driving licence", "driver's license", "national ID", "identity card", "codice fiscale", "ID card", "tax id", "aadhaar", "Reisepass", "Personnr.", "pnr.", "NINO", "NI no.", "personal number", "passport no.", "ID no."],
    "dthing": ["der Schlüssel", "die Prüfung", "das Büro", "der Zug", "das große Fahrrad", "die Küche", "der Kuchen", "mein Handy"],
    "ething": ["la llave", "el autobús", "la canción", "mi teléfono", "el mercado", "a canção", "a estação", "o trem"],
    "fthing": ["la clé", "le garçon", "le marché", "la musique", "le gâteau", "mon vélo"],
    "dpred": LANGUAGES["de"][1].split("|"), "epred": LANGUAGES["es"][1].split("|"), "fpred": LANGUAGES["fr"][1].split("|"),
    "interj": "cheers same nope lol ta yay no what morning night sure hm nice wow ok yes thanks sorry hello great omg ugh please why really haha perfect done later soon ouch aha brilliant".split(),
    "day": "monday tuesday wednesday thursday friday saturday sunday Monday Tuesday Wednesday Thursday Friday Saturday Sunday easter Christmas january May August".split(),
    "verb": "owes gives gave took sold bought brings brought makes made cooks lends lent showed found wants likes hates needs paid promised sends sent drove picked kept ordered lost borrowed remembers fixed cleaned knows thinks said told asked".split(),
    "verbing": "picking driving bringing taking making giving fetching lending cooking selling asking calling watching looking leaving collecting dropping".split(),
    "food": "soup|bread|noodles|pizza|chips|a curry|pancakes|cheese|toast|scones|biscuits|a salad|tea|an omelette|rice|eggs|a sandwich|sausages|apple pie|chocolate|coffee|a latte|olives|jam|a stew|crackers".split("|"),
    "thing": THINGS, "person": PEOPLE, "spot": SPOTS, "when": WHEN, "pred": PREDICATES, "!": ["", "!", "!!", " so much", " again"],
}
_SLOT = re.compile(r"\{([^{}]*)\}")


def parts(which: str) -> Part:
    third = lambda names, held: [n for i, n in enumerate(names) if (i % 3 == 2) == held]
    held = which == "held"
    return Part(FRAMES[which], third(GIVEN, held), third(SURNAMES, held), which)


@lru_cache(maxsize=4)
def template_words(which: str = "fit") -> frozenset[str]:
    """Small words of frames and lists: the only words whose identity the field may use."""
    out: list[str] = []
    for fs in FRAMES[which].values():
        out += fs
    for v in SLOTS.values():
        out += v
    for code, langs in LANGUAGES.items():
        if code not in UNSEEN:
            out += langs
    out += [*OPENERS, *TAILS, *TITLES, *ECHOES[which]]
    return frozenset(w for t in out for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", _SLOT.sub(" ", t).lower()))


class Writer:
    """Writes labelled texts of one part of the grammar: ``(text, [(start, end, kind)])``."""

    def __init__(self, which: str, seed: int, filler: list[str] | None = None):
        self.part, self.rng = parts(which), random.Random(f"{which}{seed}")
        self.filler = filler or []
        self.last: tuple[str, str] | None = None
        self.said: list[tuple[str, str]] = []

    def pick(self, items: list[str]) -> str:
        return self.rng.choice(items)

    def invented(self, least: int = 2) -> str:
        """A made-up proper noun: syllables, with the ends surnames and places have in many languages."""
        r = self.rng
        on = ["b", "br", "c", "d", "dr", "f", "fl", "g", "gr", "h", "j", "k", "kl", "l", "m", "n", "p", "pl", "r", "s", "sh", "st", "t", "tr", "v", "w", "z", ""]
        va = ["a", "e", "i", "o", "u", "a", "e", "i", "o", "ai", "ee", "ou"] + (["ä", "é", "ö", "á", "ü", "ã"] if r.random() < 0.2 else [])
        co = ["", "", "n", "r", "l", "s", "m", "nd", "rt", "ck"]
        body = "".join(r.choice(on) + r.choice(va) + r.choice(co if i else ["", "", "n", "r", "l"]) for i in range(r.randint(least, 4)))
        ends = ["", "", "son", "er", "ski", "ova", "ov", "ez", "es", "mann", "berg", "stein", "lund", "sen", "ini", "oglu", "ian", "ard", "is", "as", "ek", "ey", "um", "an", "en", "in", "ic", "a", "i", "o"]
        return (body + r.choice(ends)).capitalize()

    def given(self) -> str:
        return self.invented(1) if self.rng.random() < 0.25 else self.pick(self.part.given)

    def surname(self) -> str:
        return self.invented() if self.rng.random() < 0.6 else self.pick(self.part.surnames)

    def cased(self, name: str) -> str:
        x = self.rng.random()
        return name.lower() if x < 0.14 else name.upper() if x < 0.19 else name

    def name(self) -> str:
        r, g, s = self.rng, self.given(), self.surname()
        if r.random() < 0.06:
            s += "-" + self.surname()
        self.last = (g, s)
        x = r.random()
        if x < 0.30:
            return self.cased(f"{g} {s}")
        if x < 0.50:
            return self.cased(g)
        if x < 0.57:
            return s
        if x < 0.70:
            return f"{self.pick(TITLES)} {s if r.random() < 0.8 else g + ' ' + s}"
        if x < 0.77:
            return f"{g[0]}. {s}"
        if x < 0.80:
            return f"{g[0]} {s}"
        if x < 0.87:
            return f"{s.upper() if r.random() < 0.5 else s}, {g if r.random() < 0.8 else g[0] + '.'}"
        if x < 0.91:
            return f"{g} {self.pick(list('ABCDEFGHJKLMNPRSTW'))}. {s}"
        if x < 0.94:
            return f"{g} {self.given()} {s}"
        if x < 0.97:
            return f"{g} {self.pick(['de', 'van', 'von', 'van der', 'al', 'bin', 'da', 'del'])} {s}"
        return f"{g} {s[0]}."

    def digits(self, n: int, first: str = "123456789") -> str:
        return self.rng.choice(first) + "".join(self.rng.choice("0123456789") for _ in range(n - 1))

    def letters(self, n: int) -> str:
        return "".join(self.rng.choice("ABCDEFGHJKLMNPRSTWXYZ") for _ in range(n))

    def email(self) -> str:
        r, g, s = self.rng, self.given().lower(), self.surname().lower()
        user = self.pick([f"{g}.{s}", f"{g}_{s}", f"{g}-{s}", g, f"{g[0]}{s}", f"{s}{r.randint(1, 2010)}", f"{g}.{s}{r.randint(1, 99)}", f"{g}+{self.pick(['news', 'shop'])}"])
        user = re.sub(r"[^\w.+\-]", "", user)
        host = self.invented(1).lower() + self.pick(["", "mail", "post", "-net"])
        top = self.pick(["com", "org", "net", "de", "co.uk", "fr", "example", "io", "com.br", "test", "invalid", "info"])
        mail = ("mail." if r.random() < 0.1 else "") + f"{host}.{top}"
        x = r.random()
        if x < 0.12:
            at, dot = self.pick([" at ", " (at) ", "[at]", " [at] ", "{at}"]), self.pick([" dot ", " (dot) ", "[dot]", ".", "{dot}"])
            return user.replace(".", dot if dot == " dot " else ".") + at + mail.replace(".", dot)
        if x < 0.17:
            return f"{user} @ {mail}"
        out = f"{user}@{mail}"
        return out.upper() if x < 0.23 else f"<{out}>" if x < 0.27 else f"mailto:{out}" if x < 0.31 else out

    def phone(self) -> str:
        r, d = self.rng, self.digits
        x = r.random()
        if x < 0.08:
            words = "zero one two three four five six seven eight nine oh".split()
            out = [self.pick(words) for _ in range(r.randint(8, 12))]
            if r.random() < 0.3:
                out[r.randrange(len(out))] = self.pick(["double five", "triple two", "double oh"])
            return self.pick(["", "", "plus "]) + " ".join(out)
        if x < 0.14:
            return " ".join(d(r.randint(10, 11), "0"))
        cc = self.pick(["+44", "+1", "+49", "+33", "+34", "+61", "+353", "+351", "+91", "0044", "0049", "0033", "+90", "+48", "+46"])
        tail = f" {self.pick(['ext', 'x', 'ext.'])} {d(r.randint(2, 4))}" if r.random() < 0.05 else ""
        kind = r.randrange(13)
        if kind == 0:
            out = f"{cc} {d(4)} {d(6)}"
        elif kind == 1:
            out = f"{cc} {d(2)} {d(4)} {d(4)}"
        elif kind == 2:
            out = f"{cc}{d(10)}"
        elif kind == 3:
            out = f"({d(3)}) {d(3)}-{d(4)}"
        elif kind == 4:
            out = f"{d(3)}{(c := self.pick(['-', '.', ' ']))}{d(3)}{c}{d(4)}"
        elif kind == 5:
            out = f"0{d(4)} {d(6)}"
        elif kind == 6:
            out = f"0{d(4)} {d(3)} {d(3)}"
        elif kind == 7:
            out = f"0{d(2)} {d(4)} {d(4)}"
        elif kind == 8:
            out = f"0{d(1)}" + "".join((c if i else self.pick([" ", "."])) + d(2) for i, c in enumerate([" "] * 4))
        elif kind == 9:
            out = f"0{d(10)}"
        elif kind == 10:
            out = f"0{d(3)} {d(3)} {d(3)}"
        elif kind == 11:
            out = f"{d(3, '679')} {d(3)} {d(3)}" if r.random() < 0.5 else f"{d(3, '679')} {d(2)} {d(2)} {d(2)}"
        else:
            out = f"{cc} (0){d(3)} {d(3)}-{d(4)}" if r.random() < 0.4 else f"0{d(3)}/{d(7)}" if r.random() < 0.3 else f"{cc}-{d(3)}-{d(3)}-{d(4)}"
        if r.random() < 0.12:
            out = out.replace(" ", self.pick(["-", "."]))
        return self.pick(["", "", "", "", "", "tel:"]) + out.replace(" ", "") + tail if kind == 2 else out + tail

    def id_number(self) -> str:
        r, d, a = self.rng, self.digits, self.letters
        kind = r.randrange(11)
        if kind == 0:
            x = [a(2), d(2), d(2), d(2), r.choice("ABCD")]
            return self.pick([" ", ""]).join(x)
        if kind == 1:
            return f"{d(3)}-{d(2)}-{d(4)}"
        if kind == 2:
            return f"{d(8)}{self.pick(['', '-', ' '])}{a(1)}"
        if kind == 3:
            return f"{r.choice('XYZ')}{self.pick(['', '-'])}{d(7)}{self.pick(['', '-'])}{a(1)}"
        if kind == 4:
            return f"{r.randint(30, 99)}{r.randint(10, 12)}{r.randint(10, 28)}{self.pick(['-', '-', '+'])}{d(4)}"
        if kind == 5:
            return f"{d(4, '0123456789')} {d(4)} {d(4)}"
        if kind == 6:
            return f"{a(1)}{d(8)}"
        if kind == 7:
            return d(9)
        if kind == 8:
            return f"{a(5)}{d(6)}{a(1)}{d(1)}{a(2)}" if r.random() < 0.6 else f"{a(5)} {d(6)} {a(1)}{d(2)}{a(2)}"
        if kind == 9:
            return f"{a(2)}{d(7)}"
        return f"{a(6)}{d(2)}{a(1)}{d(2)}{a(1)}{d(3)}{a(1)}"

    def town(self) -> str:
        ends = ["ton", "ham", "wick", "mere", "ford", "by", "worth", "ville", "burg", "stadt", "field", "more", "ley", "dle", "mouth", "rey", "moor", "holm", "wold", "stead", "combe", "minster", ""]
        out = self.invented(1)[:7] + self.pick(ends)
        return out + self.pick([" Hill", " End", " Cross", " Green", " Park"]) if self.rng.random() < 0.15 else out

    def postcode(self) -> str:
        return f"{self.letters(2)}{self.digits(self.rng.randint(1, 2))} {self.digits(1)}{self.letters(2)}"

    def address(self) -> str:
        r, d = self.rng, self.digits
        no = d(r.randint(1, 3)) + self.pick(["", "", "", "", "A", "b"])
        noun = self.pick(["Oak", "Station", "Church", "Park", "Victoria", "Green", "Elm", "North", "River", "Beech Hill", "Meadow", "Rose Hill", "Long", "Bridge"] + [self.invented(1) for _ in range(14)])
        kind = r.randrange(9)
        end = self.pick([lambda: "", lambda: f", {self.town()}", lambda: f", {self.town()} {self.postcode()}", lambda: f"\n{self.town()}\n{self.postcode()}", lambda: f", {self.postcode()}"])()
        if kind < 4:
            way = self.pick(["Street", "Road", "Avenue", "Lane", "Drive", "Close", "Crescent", "Terrace", "Parade", "Court", "Place", "Way", "Gardens", "St", "Rd", "Ave.", "St.", "Boulevard", "Ln"])
            if way.endswith(".") and end:
                way = way[:-1]
            lead = self.pick(["", "", "", f"Flat {d(r.randint(1, 2))}, ", f"Apt {d(2)}, ", f"{d(1)}/", f"Unit {d(1)}, "])
            out = f"{lead}{no} {noun} {way}{end}"
        elif kind == 4:
            out = f"{no}{self.pick(['', ' bis', ' ter'])}{self.pick(['', ','])} {self.pick(['rue', 'avenue', 'place', 'chemin'])} {self.pick(['de la', 'du', 'des', 'de'])} {self.invented(1)}{self.pick(['', ' ' + self.invented(1)])}{self.pick(['', ', ' + self.town()])}"
        elif kind == 5:
            out = f"{self.pick(['Calle', 'C/', 'Avda.', 'Plaza', 'Paseo'])} {self.pick(['de ', 'del ', ''])}{self.invented(1)} {no}{self.pick(['', f', {d(1)}o {self.letters(1)}', f', {d(1)}º {self.letters(1)}'])}"
        elif kind == 6:
            out = f"{self.invented(1)}{self.pick(['straße', 'weg', 'gasse', 'platz', 'allee', 'strasse'])} {no}{self.pick(['', f', {d(5)} {self.town()}', f', {d(5, chr(48))} {self.town()}'])}"
        elif kind == 7:
            out = f"{self.pick(['PO Box', 'P.O. Box', 'p.o. box'])} {d(r.randint(2, 4))}{self.pick(['', ', ' + self.town()])}"
        else:
            out = f"{no} {noun} {self.pick(['Street', 'Road', 'Avenue'])}, {self.town()}, {self.letters(2)} {d(5)}"
        return out.lower() if r.random() < 0.25 else out

    def business(self) -> str:
        lead = self.pick(["The {a} {b}", "Café {n}", "Casa {n}", "{n}'s Bakery", "the {n} Arms", "Bistro {n}", "The {n} Inn", "{n} Pizza", "the {a} {b}"])
        a, b = self.pick("Golden Blue Old Silver Green Lazy Crooked Happy Black Rusty".split()), self.pick("Lion Kettle Swan Barrel Anchor Bell Goose Spoon Lantern Fox".split())
        if self.filler and self.rng.random() < 0.5:
            a, b = self.pick(self.filler).capitalize(), self.pick(self.filler).capitalize()
            lead = self.pick(["The {a} {b}", "{a} & {b}", "{a} {b}", "The {b}", "The {a} {b}", "{a} and {b}"])
        return lead.format(a=a, b=b, n=self.invented(1))

    def foreign(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A plain sentence of another language, now and then about somebody."""
        r = self.rng
        code = self.pick([c for c in LANGUAGES if (c in UNSEEN) == (self.part.seed == "held")])
        thing, said, when = (self.pick(t.split("|")) for t in LANGUAGES[code])
        if code not in ("zh", "ja", "ru", "el") and r.random() < 0.15:  # a rare word in place of a known one
            head, _, last = thing.rpartition(" ")
            odd = self.invented(1)
            thing = f"{head} {odd if code == 'de' else odd.lower()}" if head else thing
        said = said.replace("{n}", str(r.randint(2, 99)))
        gap = "" if code in ("zh", "ja") else " "
        named = r.random() < 0.12 and gap
        lead = "" if r.random() < 0.3 else when + gap
        who = self.name() if named else thing
        text = lead + who + gap + said
        spans = [(len(lead), len(lead) + len(who), "name")] if named else []
        if code == "es" and lead.startswith("¿"):
            text += "?"
        return text, spans

    def plain(self, slot: str) -> str:
        r, d = self.rng, self.digits
        made: dict[str, Callable[[], str]] = {
            "town": self.town, "business": self.business, "n": lambda: str(r.randint(1, 60)),
            "order": lambda: self.pick([f"{d(4)}-{d(4)}", d(r.randint(6, 12)), f"#{d(6)}", f"{self.letters(2)}-{d(6)}", f"{d(3)}-{d(7)}-{d(7)}", f"{self.letters(3)}{d(7)}", f"{d(5)}/{d(2)}", f"{d(4)} {d(4)}"]),
            "code": lambda: self.pick([d(4), d(6) + "#", d(6), f"{self.letters(1).lower()}{d(4)}", f"*{d(4)}"]),
            "price": lambda: self.pick([f"{r.randint(1, 9)},{d(3)}.00", f"£{r.randint(1, 90)}.{d(2)}", f"€{r.randint(1, 90)}.{d(2)}", f"¥{d(3)}", f"${d(2)}", f"{r.randint(2, 99)} €", f"{d(3)}.00", f"{r.randint(1, 9)}.{d(3)},50 €", f"{r.randint(2, 90)} zł", f"{r.randint(2, 90)} quid", f"{r.randint(2, 90)} bucks", f"£{r.randint(2, 400)}", f"${r.randint(2, 400)}", f"{d(2)},{d(2)}"]),
            "time": lambda: self.pick([f"{r.randint(0, 23)}:{r.randint(0, 5)}{r.randint(0, 9)}", f"{r.randint(1, 12)}:{r.choice('0134')}{r.choice('05')}", f"{r.randint(1, 12)}pm", f"{r.randint(1, 12)}.30", f"quarter past {r.randint(1, 12)}", f"half {r.randint(1, 12)}"]),
            "date": lambda: self.pick([f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1950, 2030)}", f"the {r.randint(4, 20)}th", f"{r.randint(1950, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.", f"{r.randint(2, 28)} March", f"May {r.randint(2, 28)}"]),
            "flight": lambda: f"{self.letters(2)} {d(r.randint(3, 4))}", "url": lambda: f"{self.invented(1).lower()}.{self.pick(['com', 'org', 'example', 'net'])}",
        }
        if slot in made:
            v = made[slot]()
            if slot in ("town", "order"):
                self.said.append(("", v))
            return v
        if slot == "Cap":  # a sentence may start with any word in capitals
            return (self.pick(self.filler) if self.filler and r.random() < 0.7 else self.pick(SLOTS["food"])).capitalize()
        if slot in ("thing", "food") and r.random() < (0.3 if slot == "food" else 0.12):  # rare words in small letters are things too
            odd = self.invented(1).lower()
            if r.random() < 0.3:
                odd = odd.translate(str.maketrans("aeioun", self.pick(["âéîôûñ", "áèíóúñ", "äéïöün"])))
            return self.pick(["", "the ", "a ", "some ", "our ", "two "]) + odd + self.pick(["", "", " " + self.invented(1).lower(), " cake"])
        if slot in ("thing", "person") and self.filler and r.random() < 0.35:
            return self.pick(["the ", "a ", "my ", "some ", "our ", "their ", ""]) + self.pick(self.filler) + self.pick(["", "", " " + self.pick(self.filler)])
        return self.pick(SLOTS[slot])

    def expand(self, frame: str) -> tuple[str, list[tuple[int, int, str]]]:
        kinds = {"N": ("name", self.name), "EMAIL": ("email", self.email), "PHONE": ("phone", self.phone), "ID": ("id_number", self.id_number), "ADDRESS": ("address", self.address)}
        out, spans, todo = "", [], [frame]
        while todo:
            t = todo.pop()
            m = _SLOT.search(t)
            if m is None:
                out += t
                continue
            out += t[: m.start()]
            slot, rest = m.group(1), t[m.end() :]
            todo.append(rest)
            if slot in kinds or slot in ("L", "G"):
                kind, make = kinds.get(slot, ("name", lambda: self.last[slot == "L"]))
                v = make()
                spans.append((len(out), len(out) + len(v), kind))
                out += v
                self.said.append((kind, self.pick([*self.last, v]) if kind == "name" else v))
            else:
                todo.append(self.plain(slot))
        return out, spans

    def sentence(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.rng
        kind = r.choices(["name", "email", "phone", "id_number", "address", "", "foreign"], [27, 7, 8, 8, 9, 30, 11])[0]
        text, spans = self.foreign() if kind == "foreign" else self.expand(self.pick(self.part.frames[kind]))
        if kind in ("", "foreign", "name") and r.random() < (0.12 if kind == "foreign" else 0.06) and len(text.upper()) == len(text):
            text = text.upper()
        text = re.sub(r" +$", "", text)
        lead, tail = self.pick(OPENERS) if r.random() < 0.5 else "", self.pick(TAILS)
        if r.random() < 0.4 and not lead and text and (not spans or spans[0][0] > 0):
            text = text[0].upper() + text[1:]
        return lead + text + tail, [(s + len(lead), e + len(lead), k) for s, e, k in spans]

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans = "", []
        self.said = []
        for i in range(self.rng.choices([1, 2, 3, 4], [45, 30, 17, 8])[0]):
            if self.said and self.rng.random() < 0.35:
                kind, value = self.pick(self.said)
                if value.isalpha() and self.rng.random() < 0.35:  # or something that resembles it
                    value = self.pick([value + "'s", value + "’s", value + value[-1], value[:-1], value.lower(), value + "s", value[:-2] + value[-1] + value[-2]])
                before, after = self.pick(ECHOES[self.part.seed]).replace("{adj}", self.pick(SLOTS["adj"])).split("{E}")
                s, found = before + value + after, [(len(before), len(before) + len(value), kind)] if kind else []
            else:
                s, found = self.sentence()
            if i:
                out += self.pick(JOINS)
            spans += [(a + len(out), b + len(out), k) for a, b, k in found]
            out += s
        if not out.isascii() and self.rng.random() < 0.08:  # characters lost on the way
            out = re.sub("[\u0080-\u024f]", "\ufffd", out)
        return out, spans

    def texts(self, n: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
        for _ in range(n):
            yield self.text()
