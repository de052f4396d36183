import os
import sys

import pytest

from weftline.llm import notice_grammar, residue

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from notices import ARTICLES, NOTICES  # noqa: E402

ARTICLE = "The quiet harbour of Olwi measures every boat twice a week. In 1912 the bakers of the town brought 40 boxes of bread, and the mayor thanked them."
CASES = [
    "Page not found\nThe page you requested does not exist.", "404", "500 Internal Server Error\nOur system failed and could not complete your request. Staff have been told.",
    "Home | News | Contact | Help\nYou need to have JavaScript enabled to use Olwi.\nTerms of use | Privacy | Imprint", "Checking your browser before you continue. This may take 9 seconds. Keep scripts on.",
    "Dear {{first_name}}, thank you for visiting {{city}}.\nYour order {{ORDER_ID}} will reach {{city}} by {{date}}.", "Welcome to %SiteName%, the home of %author% since %date%.", "Posted on [date] by [author]\nCall [phone] or write to [user.email].",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore.", "Early report: Olwi\nblah blah blah blah blah blah blah blah\nblah blah blah blah blah blah", "Your text goes here.\nClick edit to change.\nReplace this paragraph with your own words.",
    "Seite nicht gefunden\nDie angeforderte Seite existiert nicht mehr.", "Diese Anwendung benötigt Skripte. Bitte zulassen.", "Hier steht Beispieltext.\nInhalt folgt bald.", "Accès refusé\nVous n’avez pas le droit de voir cette page.", "Veuillez activer JavaScript pour afficher cette page.",
    "Página no encontrada\nLa página pedida no existe.", "Este es un texto de relleno.\nSu texto va aquí.", "PÃ¡gina no encontrada\nLa pÃ¡gina pedida no existe.", "Database connection failed\nToo many connections in /srv/ab12/db.inc on line 7",
    "Session expired\nYour login has timed out. Please sign in again to continue.", "P\x00a\x00g\x00e\x00 \x00n\x00o\x00t\x00 \x00f\x00o\x00u\x00n\x00d\x00",
]
FINE = [
    ARTICLE, "Olwi has one harbour and two bakeries.", ARTICLE + "\nWhy a page says “404 Not Found” is simple: the address points nowhere.", "Printers have used lorem ipsum as filler text for a long time. " + ARTICLE,
    "In the template, {{ title }} stands for the heading, and ${price} for the cost.\nA placeholder such as %NAME% is replaced before the letter is printed. " + ARTICLE, "Please enable JavaScript to use this page.\n" + ARTICLE,
    "How to write a template\n```\n{{a}} {{b}} {{c}} {{d}}\n```\nThe engine replaces each name by its value when the page is served.", "", "   ", "Home | News | Contact | Help\nWe use cookies to improve your visit. Accept all | Reject | Settings",
    "Ohne tägliche Säge fehlt die Küche, sagen die Mitglieder.", "La cuerda protege la huerta cerca de Tortorda, y nadie lo sabe.", "Sin plaza la señal protege la cocina. " * 300,
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert residue.verdict(text), residue.weigh(text)


@pytest.mark.parametrize("text", FINE)
def test_content(text):
    assert residue.verdict(text) is None, residue.weigh(text)


def test_notices_collected_before_their_rules():
    """At least 80 % of public notices, and none of as many articles that mention such wording."""
    missed = [t for t in NOTICES if not residue.verdict(t)]
    assert len(NOTICES) >= 60 and len(missed) <= len(NOTICES) // 5, missed
    assert len(ARTICLES) >= 60 and not [t for t in ARTICLES if residue.verdict(t)]


def test_long_notice_sentences_are_judged():
    long = "The requested page could not be found on this server and " * 8 + "is no longer available"
    assert len(long.split()) > 80 and residue.verdict(long)


@pytest.mark.parametrize("text", ["The site of the castle was moved in 1840 by monks.", "The page was torn from the book.", "Sans cuisine cette veste mène et éclaire la serrure et la allée.", "La casa de adobe es una obra de la abuela y no se vende."])
def test_prose_is_no_notice(text):
    q = residue.squash(text)
    assert not notice_grammar.says(q) and residue.verdict(text) is None


def test_lost_guillemets():
    assert residue.verdict("Hola \ufffdproduct_name\ufffd, gracias.\n\ufffdORDER_ID\ufffd ofrece \ufffdcity\ufffd por \ufffdpage.title\ufffd.") == "template"
    assert residue.verdict("Page introuvable\nLa page demand\ufffde a \ufffdt\ufffd d\ufffdplac\ufffde.") == "residue"


def test_table(spark):
    rows = [(i, t, "a", 1) for i, t in enumerate(CASES + FINE)] + [(None, CASES[0], "a", 1), (500, None, "a", 1), (0, CASES[0], "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, t int")
    got = [r["doc_id"] for r in residue.residue_documents(df).collect()]
    assert sorted(got) == [0, *range(len(CASES))]
    assert residue.residue_documents(df.where("false")).count() == 0
