import base64
import itertools
import random
import re

from pyspark.sql import functions as F

from tallywind.llm import template as T
from tallywind.llm.mail import own_text
from tallywind.llm.residue import find_residue
from tallywind.llm.template import is_filler, labels, sentences, take_apart

HEAD = "From: A <a@x.test>\nSubject: s\nMIME-Version: 1.0\n"


def mail(body, kind="text/plain", more=""):
    return f"{HEAD}Content-Type: {kind}; charset=utf-8\n{more}\n{body}"


def test_own_text():
    plain = "Hi Bo,\n\nfirst line.\n\nOn 1/2/2025 10:00, Al wrote:\n> quoted {{x}}\n\nsecond line.\n\nThanks,\nAl\n+00 00 5550\n\n____\nconfidential"
    assert own_text(mail(plain)).text.split() == "Hi Bo, first line. second line.".split()
    assert own_text(mail("mine\r\n\r\n-----Original Message-----\r\nFrom: x\r\n\r\ntheirs")).text == "mine"
    coded = base64.b64encode("olá ação".encode()).decode()
    assert own_text(mail(coded, more="Content-Transfer-Encoding: base64\n")).text == "olá ação"
    assert own_text(mail("a=C3=A7=\n=C3=A3o", more="Content-Transfer-Encoding: quoted-printable\n")).text == "ação"
    html = "<html><head><title>t</title></head><body><p>a&amp;b</p><blockquote>no</blockquote><p>c<br>> q</p><noscript>enable it</noscript></body></html>"
    own = own_text(mail(html, "text/html"))
    assert own.text.split() == ["a&b", "c"] and own.notice == "enable it"
    parts = f'{HEAD}Content-Type: multipart/mixed; boundary="=_q"\n\npreamble\n--=_q\nContent-Type: text/plain\n\nbody\n--=_q\nContent-Type: text/plain\nContent-Disposition: attachment; filename=x\n\nattached\n--=_q\nContent-Type: message/rfc822\n\nFrom: z\n\ncarried\n--=_q--\n'
    assert own_text(parts).text.strip() == "body"
    assert own_text(mail("Ã©tÃ© aÃ§Ã£o")).text == "été ação"
    for nothing in (None, "", "  \n ", "From: a\n\n"):
        assert own_text(nothing).text == ""
    assert own_text("no header at all").text == "no header at all"
    assert len(own_text(mail("word " * 200_000)).text) > 900_000


def test_take_apart():
    a = take_apart("Total charged: US$ 12,50 for São João da Serra by 01/02/2026.")
    b = take_apart("Total charged: {{ amount }} for ${city} by (null).")
    assert a[0] == b[0] == "charged for by" and a[1] == "PPPP" and b[1] == "PVVN"
    assert take_apart("Reference: 123") == ("reference", "BP") and take_apart("Reference: <ORDER ID>") == ("reference", "BV") and take_apart("Reference:") == ("reference", "BB")
    assert take_apart("") == ("", "P") and take_apart("Oh no!") == ("no", "PP")
    assert [s for s, _, _ in sentences('He said "please {{x}} now". And `{y}` too.\n    code {z}')][0].count("{") == 0


def test_labels():
    for text in ("asdf asdf asdf asdf", "Lorem ipsum dolor sit amet.", "Your text here", "--- --- --- --- ---", "zxcv bnmz xcvb nmzx"):
        assert is_filler(text), text
    for text in ("Please send the report.", "O texto aqui é sobre a nova tabela de preços e o contrato.", ""):
        assert not is_filler(text), text
    assert labels(sentences("Hi Bo,\n\n404 Not Found\n\nReload")) == ["G", "S", "G"]
    assert labels(sentences("You need to enable JavaScript to run this app.")) == ["S"]
    assert set(labels(sentences("Since 9:00 the quotes page answers 404 Not Found for 5 of our links. I traced it to the renamed folder.")).__iter__()) >= {"O"}


def test_find_residue(spark):
    rng = random.Random(4)
    name = lambda: rng.choice(["Kaba", "Graru", "Moxan", "Tili"])
    data = []
    for i in range(60):
        data.append((i, mail(f"Dear {name()},\n\nyour parcel {rng.randrange(10**6)} left on 01/0{1 + i % 9}/2025 and should reach {name()} by noon.\n\nReference: {i}")))
        data.append((100 + i, mail(f"Hi {name()},\n\nThanks for the quick answer about the table. The volume of USD_BRL doubled after lunch.")))
        data.append((200 + i, mail(f"The welcome mail still went out with {{{{ name }}}} in the greeting for {name()}. A fix is in review.")))
    cases = {
        1000: mail("Dear {{name}},\n\nyour parcel 5 left on 01/01/2025 and should reach Kaba by noon.\n\nReference: 7"),
        1001: mail("Dear Kaba,\n\nyour parcel undefined left on 01/01/2025 and should reach Kaba by noon.\n\nReference: 7"),
        1002: mail("Dear Kaba,\n\nyour parcel 5 left on and should reach Kaba by noon.\n\nReference: 7"),
        1003: mail("Dear Kaba,\n\nyour parcel 5 left on 01/01/2025 and should reach Kaba by noon.\n\nReference: [ORDER ID]"),
        1004: mail("lorem ipsum dolor sit amet elit.\n\nSed magna ipsum lorem dolor."),
        1005: mail("Hi Kaba,\n\n503 Service Unavailable\n\nThanks,\nTili"),
        1007: mail("Dear ,\n\nyour parcel 5 left on 01/01/2025 and should reach Kaba by noon.\n\nReference: 8"),
        1006: mail("<p></p><noscript>Please enable JavaScript to view this page.</noscript>", "text/html"),
    }
    fine = {
        2000: mail("Hi,\n\nuse `{{name}}` here.\n\n> Dear {{name}},"),
        2001: mail("<p>Thanks for the quick answer about the table.</p><noscript>Please enable JavaScript.</noscript>", "text/html"),
        2002: mail('Yesterday people saw "404 Not Found" here. I moved the folder.'),
        2003: None,
        2004: "",
        2005: "   ",
        2006: mail(" ".join(f"report{i % 977}" for i in range(100_000))),
    }
    data += [*cases.items(), *fine.items(), (1005, cases[1005])]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("reason", F.lit(1))
    got = {r.doc_id: r.reason for r in find_residue(df).collect()}
    assert set(got) == set(cases)
    assert got[1000] == "unfilled" and got[1004] == got[1005] == got[1006] == "page"
    assert find_residue(df.limit(0)).count() == 0


def test_pages_with_unlisted_sentences(spark):
    notice = "We're sorry but my-app doesn't work properly without JavaScript enabled. Please enable it to continue."
    gone = "The page was not found. Use the search on our start page instead."
    long = "Because this bulletin draws every one of its tables and figures while you look at it, you have to enable JavaScript in your browser before any of it can be shown to you here."
    report = "Several readers complain that our bulletin tells them to enable JavaScript. I moved the table into static markup, so that message is gone now."
    reporte = "Vários leitores dizem que o boletim pede para ativar JavaScript. Coloquei a tabela em texto simples e a mensagem sumiu."
    short = "Since 9:00 the quotes page answers 404 Not Found for 5 of our links. I traced it to the renamed folder and put redirects in place."
    plain = "The room is booked for the morning. Please bring the ledger with you."
    full = "Your parcel has left. The courier rings twice. Somebody should be at home. If the map is unavailable, look at the slip."
    pages, fine = (notice, gone, long), (report, reporte, short, plain, full)
    data = [(100 * k + i, mail(text)) for k, text in enumerate(pages + fine) for i in range(5)]
    got = {r.doc_id for r in find_residue(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {100 * k + i for k in range(len(pages)) for i in range(5)}


def spelt(pattern):
    """Texts that together take every branch and every number of repetitions (at most two) of a regular expression."""

    def run(tree):
        out = [""]
        for op, x in tree:
            op = str(op)
            if op == "LITERAL":
                more = [chr(x)]
            elif op == "IN":
                more = [chr(y) if str(o) == "LITERAL" else "w" for o, y in x]
            elif op == "BRANCH":
                more = [t for b in x[1] for t in run(b)]
            elif op == "SUBPATTERN":
                more = run(x[3])
            elif op == "MAX_REPEAT":
                more = ["".join(t) for n in range(x[0], min(int(x[1]), max(x[0], 2)) + 1) for t in itertools.product(run(x[2]), repeat=n)]
            else:
                assert op == "AT", op
                more = [""]
            out = [a + b for a in out for b in more]
        return out

    return set(run(re._parser.parse(pattern)))


def test_hints_cover_the_labels():
    for pattern, hints in T._PLACES:
        for text in spelt(pattern):
            assert re.fullmatch(pattern, text, re.I) and any(h in text.lower() for h in hints), text
    assert all(any(h in t for h in T._HINTS) for t in spelt(T._SCRIPT.pattern))
    rng = random.Random(8)
    pick = lambda words, n: " ".join(rng.choice(sorted(words)) for _ in range(n))
    latin = ["Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.", "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit."]
    texts = latin + ["This bulletin requires JS, which your browser currently has off.", "Precisa-se de (JS).", "We met. asdf asdf asdf asdf asdf", "qwer-asdf-zxcv-qwer", "Enter your message", "TODO", "Add new content", "ſample text", "Error " + "-" * 120 + " 404"]
    texts += [pick(T._LATIN, 3 + k % 9) for k in range(300)] + sorted(t for p, _ in T._PLACES for t in spelt(p)) + [f"Error {n}" for n in (400, 404, 500)]
    texts += [f"{p} x" for p in T._PAGE] + [f"Please enable {t}." for t in spelt(T._SCRIPT.pattern)]
    for text in texts:
        parts = sentences(text)
        assert T.hinted(text, parts) or not set(labels(parts)) & set("SFL"), text
    assert all(set(labels(sentences(t))) & set("SFL") for t in texts[:3] + texts[4:8])
    assert not is_filler("You were to try it, or we quote your property.")
    assert not T.hinted("The room is booked for the morning.", sentences("The room is booked for the morning."))


def test_unfilled_majority(spark):
    good = lambda i: mail(f"Dear Kaba,\n\nyour parcel {i} left on 01/0{1 + i % 9}/2025 and should reach Tili by noon.")
    failed = mail("Dear {{name}},\n\nyour parcel {{id}} left on {{date}} and should reach {{to}} by noon.")
    blank = mail("Dear Kaba,\n\nyour parcel left on and should reach Tili by noon.")
    data = [(i, good(i)) for i in range(8)] + [(100 + i, failed) for i in range(40)] + [(200 + i, blank) for i in range(40)]
    data += [(300, mail("Invoice: {{ invoice }}\n\nplease pay ${amount} before the end of the month.")), (301, mail("Hi [FIRST NAME],\n\nwelcome aboard."))]
    # undefined is in the minority of its slot
    data += [(310 + i, mail(f"the courier rings at {'undefined' if i else '9:30'} on the day.")) for i in range(5)]
    data += [(400, mail("The mails still show {{name}} and {{id}} because the template was renamed.")), (401, mail("People saw this line:\n\nHola {{name}}:")), (402, mail("Room: #general")), (403, mail("Thanks for the quick answer."))]
    data += [(410 + i, mail(f"We met {'Kaba ' if i else ''}for the answer about the table.")) for i in range(3)]  # too few to tell a hole
    got = {r.doc_id for r in find_residue(spark.createDataFrame(data, "doc_id long, text string")).where("reason = 'unfilled'").collect()}
    assert got == {*range(100, 140), *range(200, 240), 300, 301, *range(311, 315)}


def _mail(body, sender="a@b.example"):
    return f"From: {sender}\nSubject: x\nContent-Type: text/plain\n\n{body}"


def test_a_repeated_page_of_unknown_wording(spark):
    page = "Page introuvable\n\nLe contenu souhaité n'existe plus sur ce serveur."
    chatter = ["Nous comptons {0} lignes.", "Le volume de hier a baissé.", "Merci pour la réponse rapide.", "Je te rappelle vers {0} heures."]
    rows = [(i, _mail(page), f"s{i % 9}@x.example") for i in range(30)]
    rng = random.Random(3)
    rows += [(100 + i, _mail("\n".join(c.format(i) for c in rng.sample(chatter, rng.randrange(2, 5)))), f"s{i % 7}@x.example") for i in range(200)]
    rows += [(400 + i, _mail(f"La commande {i * 37} est partie vers Lyon le {i} mai."), f"s{i % 5}@x.example") for i in range(30)]  # filled in: no page
    rows += [(500 + i, _mail("Ce bulletin de la maison est envoyé chaque semaine."), "one@x.example") for i in range(30)]  # one sender's circular
    df = spark.createDataFrame(rows, "doc_id long, text string, from_addr string")
    assert {r.doc_id for r in find_residue(df, sender_col="from_addr").collect()} == set(range(30))
    assert find_residue(df.where("doc_id < 8"), sender_col="from_addr").count() == 0  # too few copies to tell


def test_lines_beside_known_ones_make_pages_of_their_own(spark):
    """A line that only ever stands beside page lines is one, also where it stands alone or in capitals."""
    rows = [(i, _mail(f"Error 50{i % 3}\n\nThe gremlins have eaten this view.")) for i in range(6)]
    rows += [(10, _mail("The gremlins have eaten this view.")), (11, _mail("THE GREMLINS HAVE EATEN THIS VIEW.")), (12, _mail('He wrote "The gremlins have eaten this view." and left.'))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in find_residue(df).collect()} == {*range(6), 10, 11}


def test_numbered_fields(spark):
    rows = [(i, _mail(f"Dear Ann{'abcdef'[i % 6]},\n\nyour order {i} leaves on 0{i % 9 + 1}/03/2025.")) for i in range(12)] + [(50, _mail("Dear %1$s,\n\nyour order %2$s leaves on %3$s.")), (51, _mail("It grew by 5% in June, %1 of it at night."))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in find_residue(df).collect()] == [50]
