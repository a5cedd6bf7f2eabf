"""Sentences taken apart into the fixed words of their template and the values in its slots, and what kind of line each is.

Plain functions on one text, for use inside Arrow batches.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick

#: How the value in a slot looks: proper (P), a variable name (V), an empty default (N), a blank (B).
PROPER, VARIABLE, EMPTY, BLANK = "PVNB"
#: What a sentence is: greeting, heading, signature or a page's furniture (G), filler (F), the line of an error page or a demand for scripts
#: that stands alone (S) or may belong to one (L), code or quotation (C), anything else (O).
GREETING, FILLER, SEED, LIKELY, CODE, OTHER = "GFSLCO"

_QUOTATION = re.compile(r"`[^`\n]*`|\"[^\"\n]{2,400}\"|“[^”\n]*”|«[^»\n]*[ ,.!?][^»\n]*»|„[^“”\n]*[“”]")
_CODE_LINE = re.compile(r"^(?: {4,}|\t)")

# unfilled fields: a name between marks, whatever the template language
_NAME = r"[A-Za-zÀ-ÿ_][\w .\-]{0,40}?"
_VARIABLE = re.compile(
    rf"\{{{{1,3}}[!%]? ?(?:{_NAME}|\d{{1,2}}) ?%?\}}{{1,3}}|[$#]\{{ ?{_NAME} ?\}}|<<? ?{_NAME} ?>>?|<%=? ?{_NAME} ?%>|\[\[? ?{_NAME} ?\]\]?"
    rf"|~~?{_NAME}~~?|\(\( ?{_NAME} ?\)\)|« ?[A-Za-zÀ-ÿ_][\w.\-]{{0,40}} ?»|(?<![\d%])%(?:\([\w. ]{{1,40}}\)|\d{{1,2}}\$)?[sdif](?![A-Za-z])|\^{_NAME}\^|\+\+{_NAME}\+\+|::{_NAME}::|\|\|?{_NAME}\|\|?(?! ?\w)"
    rf"|__{_NAME}__|@@{_NAME}@@|%%?[A-Za-z_]+%%?|\*\|{_NAME}\|\*|\$[A-Za-z_]{{2,}}\$|##?[A-Za-z_]{{2,}}##?(?!\w)|\b[Xx]{{3,}}\b"
)
_EMPTY = re.compile(r"\[object Object\]|\(null\)|<nil>|(?<![\w'’])(?:undefined|NaN|None|null|nil|NULL)(?![\w'’])|#N/D|#N/A|#REF!")
_FIELD_MARKS = ("{", "[", "<", "#", "%", "@@", "|", "__", "~", "((", "«", "^", "++", "::")  # every unfilled field holds one, or a dollar before a letter
_DOLLAR = re.compile(r"\$[A-Za-z_{]")
_EMPTY_MARKS = ("ull", "nil", "None", "NaN", "undefined", "[object", "#", "NULL")
_WORD = re.compile(r"[^\W\d_]+")
_ANY_MARK = re.compile("|".join(re.escape(m) for m in (*_FIELD_MARKS, *_EMPTY_MARKS)) + "|" + _DOLLAR.pattern)
_TOKEN = re.compile(r"[\x01\x02\x03]|[^\W\d_]+(?:['’-][^\W\d_]+)*|\d[\d.,:/\-]*\d|\d+|[A-Z]+_[A-Z]+|_+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")

# Small words inside names of places, and the first words of greetings
_SMALL = frozenset("da do de das dos del la el von van e".split())
_GREET = frozenset("hi hello dear hey olá ola oi caro cara prezado prezada prezados prezadas hola estimado estimada estimados estimadas hallo liebe lieber guten".split())
_GREETS = r"(?:hi|hello|dear|hey|good (?:morning|afternoon|evening)|olá|ola|oi|bom dia|boa (?:tarde|noite)|prezad[oa]s?(?:\(a\))?|car[oa]s?|hola|buenos días|buenas (?:tardes|noches)|estimad[oa]s?|hallo|guten (?:morgen|tag)|liebe[rs]?|sehr geehrte[rs]?)"
_GREETING = re.compile(
    rf"^(?:{_GREETS}\b.{{0,60}}[,:!]?|[\w\x01\x02]+ -)$",
    re.I,
)
_BARE_GREETING = re.compile(r"^[^\W\d_]+(?: [^\W\d_]+){0,2}[,:!.]?$")
_SIGNATURE = re.compile(r"^(?:\+?\d[\d ()-]{6,}|ID [\d.\-/]+|IBAN .*|(?:Rua|Av\.|Calle) .*|\S+@\S+|(?:[A-ZÀ-Ý][\w'’-]*)(?: [A-ZÀ-Ý][\w'’-]*){0,2}|Gruß,?|LG,?)$")

# The classic filler words, keyboard rows, and phrases that hold a text's place
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation "
    "ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat "
    "non proident sunt culpa qui officia deserunt mollit anim id est laborum vitae urna lacus felis neque porta quasi morbi nobis vesti kuram".split()
)
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Phrases, each with what any text that it matches holds, in lower case (TODO stands apart, as "todo" is a common word).
_PLACES = (
    (r"(?:your|insert|add|type|enter|put|sample|dummy|placeholder) (?:\w+ ){0,2}(?:text|content|copy|message)\b", (" text", " content", " copy", " message")),
    (r"(?:text|heading|content|title) (?:goes )?here", ("text here", "heading here", "content here", "title here", " goes here")),
    (r",? ?replace before sending", ("replace before sending",)),
    (r"placeholder text|body copy|copy tbd|(?-i:\bTBD\b)|blindtext|mustertext|platzhalter\w*|überschrift", ("placeholder text", "body copy", "tbd", "blindtext", "mustertext", "platzhalter", "überschrift")),
    (r"texto aqu[ií]|seu texto|su texto|digite|insira|escriba aqu[ií]|título da seção|título (?:aquí|aqui)", ("texto aqu", "seu texto", "su texto", "digite", "insira", "escriba aqu", "título da seção", "título aqu")),
    (r"conteúdo (?:provisório|da mensagem)|contenido (?:provisional|del mensaje)", ("conteúdo provisório", "conteúdo da mensagem", "contenido provisional", "contenido del mensaje")),
    (r"texto (?:provisório|de relleno|de exemplo)", ("texto provisório", "texto de relleno", "texto de exemplo")),
    (r"hier (?:steht|kommt)|inhalt (?:folgt|einfügen)", ("hier steht", "hier kommt", "inhalt folgt", "inhalt einfügen")),
)
_PLACE = re.compile("|".join([p for p, _ in _PLACES] + [r"(?-i:\bTODO\b)"]), re.I)
_PLACE_PARTS = tuple(h for _, parts in _PLACES for h in parts)
_FOLDED = ("İ", "ı", "ſ")  # letters that match i or s regardless of case, but are not i or s in lower case

# What error pages and demands for scripts say, in the four languages of the corpus
_STATUS = re.compile(
    r"^(?:(?:http|error|erro|fehler|status|código|code)\W*)*[45]\d\d\b[\w\W]{0,40}$|^[\w '’-]{0,40}(?<!\d)\(?[45]\d\d\)?[.!]?$|^(?:error|erro|fehler)\W+[45]\d\d\b.{0,40}$", re.I
)
_PAGE = tuple(
    "not found|couldn't find|couldn’t find|could not find|forbidden|unauthorized|unauthorised|access denied|permission to open|permission to view|permission to access|bad request|bad gateway|server error|unavailable|isn't available|isn’t available|"
    "connection failed|connection error|request blocked|access blocked|timed out|timeout|time-out|time out|session has ended|session has expired|session ended|session expired|sign in again|log in again|too many requests|link has expired|service is down|went wrong|error code|can't show|can’t show|cannot show|cannot display|"
    "unexpected condition|unexpected error|could not be found|could not be shown|could not finish|could not complete|could not connect|application error|checking your browser|browser settings|unusual traffic|not a robot|page has moved|page has expired|"
    "connection refused|try again later|try again in a few|contact the administrator|not completed|scripts are switched off|enable them|turn them on|request id|code: |código: |upstream|unhandled exception|stack trace|traceback|"
    "não encontr|não foi encontr|acesso negado|não autorizad|indisponível|sessão expir|sessão encerr|sessão termin|erro interno|erro inesperado|tente novamente|tente mais tarde|erro do servidor|erro no servidor|erro da aplicação|foi removido|mudou de endereço|não tem permissão|conseguimos mostrar|não foi concluíd|"
    "fora do ar|contate o administrador|concluir a sua solicitação|link expirou|deu errado|não foi possível|"
    "no encontr|no se encontr|no se ha encontr|no se pud|acceso denegado|no autorizado|no disponible|no está disponible|sesión expir|sesión ha expir|sesión caduc|sesión ha caduc|sesión termin|inténtelo|error interno|error inesperado|no tiene permiso|pudimos mostrar|error del servidor|error en el servidor|error de la aplicación|"
    "fuera de servicio|fuera de línea|contacte al administrador|no se complet|enlace caduc|enlace ha caduc|enlace expir|enlace ha expir|"
    "nicht gefunden|existiert nicht|zugriff verweigert|nicht erreichbar|nicht verfügbar|sitzung ist abgelaufen|sitzung abgelaufen|serverfehler|server-fehler|fehler im server|anwendungsfehler|später noch einmal|später erneut|keine berechtigung|fehler aufgetreten|nicht angezeigt werden|link ist abgelaufen|"
    "außer betrieb|wenden sie sich an den administrator|versuchen sie es|anfrage konnte nicht|anfrage wurde nicht".split("|")
)
_SCRIPT = re.compile(r"java ?script|\bjs\b|\bscripts?\b|\bscripting\b|client-side|secuencias de comandos|skript\w*|\bcookies\b", re.I)
_DEMAND = re.compile(
    r"enable|activate|allow|turn (?:it |them )?on|switch on|needs?\b|require|disabled|does(?:n['’]t| not) support|must be|ative|ativar|habilit|permit|ligue|precisa|necess|desativad|não executa|não suporta|active|activar|encienda|necesari|desactivad|no admite|no ejecuta|aktivier|ein(?:ge)?schalt|an(?:ge)?schalt|erlaub|zulassen|zugelassen|benötig|deaktiviert|unterstützt",
    re.I,
)
# The first person of one who reports, which pages and demands do not use; the verb forms are the past of pt and es
_SPEAKER_WORDS = r"(?<![\w-])(?:i|i['’](?:ve|d|ll|m)|me|my|mine|eu|meus?|minhas?|comigo|yo|mis?|conmigo|ich|mir|mich|mein(?:e[mnrs]?)?)(?![\w-])"
_SPEAKER = re.compile(_SPEAKER_WORDS, re.I)
_REPORT = re.compile(_SPEAKER_WORDS + r"|\b(?!(?:aqu|as|all|ah|caf|tamb|at|qu|ol|p)[éí]\b)\w{2,}[éí]\b|\b\w{3,}ei\b", re.I)
_CHROME = re.compile(r"^(?:(?:oo?ps|ops|oh no|whoops|sorry|desculpe|lamentamos|lo sentimos|entschuldigung|hoppla|ups)[!.,:]?|(?:please |por favor,? |bitte )?(?:wait|aguarde|espere|warten sie) \d+ (?:seconds?|segundos?|sekunden)\.?|reload|refresh|home|back|go back|privacy(?: \| \w+)*|terms|contact|retry|voltar|recarregar|início|volver|zurück|neu laden|at [\w.$]+\(.*\)|file \S+, line \d+.*|\w+error: .*|loading\W*.*|[\w ]{1,20}(?: [|·] [\w ]{1,20})+)$", re.I)


def sentences(own: str) -> list[tuple[str, bool, bool]]:
    """(sentence, is code, is a whole line) of a text; a quotation is replaced by one mark."""
    out = []
    for line in own.split("\n"):
        if not line.strip():
            continue
        code = bool(_CODE_LINE.match(line))
        line = _QUOTATION.sub("\x03", line.strip()).replace("#REF!", "\x02")
        parts = [s.strip() for s in _SENTENCE.split(line) if s.strip()]
        out += [(s, code, len(parts) == 1) for s in parts]
    return out


def take_apart(sentence: str) -> tuple[str, str]:
    """The key of the sentence's template and the kinds of its slots' values, one letter per gap between fixed words.

    Fixed words are words in lower case, labels before a colon and words of
    greeting; names, capitalised words, numbers, marks and unfilled fields fall
    into the gaps, so that records of one template have one key, whatever a
    slot holds, and also when it is blank.
    """
    if sentence.isupper() and len(_WORD.findall(sentence)) > 2:
        sentence = sentence.capitalize()  # written in capitals throughout: no names to tell
    if _ANY_MARK.search(sentence) or "xxx" in sentence.lower():
        sentence = _VARIABLE.sub(" \x01 ", sentence)
        sentence = _EMPTY.sub(" \x02 ", sentence)
    tokens = _TOKEN.findall(sentence)
    words, kinds, gap, anchored = [], [], BLANK, False
    for i, t in enumerate(tokens):
        if t == "\x01":
            gap = VARIABLE
        elif t == "\x02":
            gap = EMPTY if gap != VARIABLE else gap
        elif t == "\x03":
            gap = PROPER if gap == BLANK else gap
        elif t[0].isalpha():
            lower = t == t.lower()
            inside = t in _SMALL and 0 < i < len(tokens) - 1 and tokens[i - 1][:1].isupper() and tokens[i + 1][:1].isupper()
            label = i + 1 < len(tokens) and tokens[i + 1] == ":" and (i == 0 or tokens[i - 1] in ".!?")
            greeting = i == 0 and t.lower() in _GREET
            anchored |= label or greeting
            if (lower and not inside) or label or greeting:
                kinds.append(gap)
                words.append(t.lower())
                gap = BLANK
            elif gap == BLANK:
                gap = PROPER
        elif t[0].isalnum():
            gap = PROPER if gap == BLANK else gap
    if gap == BLANK and words and words[0] in _GREET and _BARE_GREETING.match(sentence):
        gap = PROPER  # a greeting of nobody by name is complete; one with a hole before its comma is not
    kinds.append(gap)
    if len(words) < 2 and not anchored:  # too little to tell a hole from a text without slots
        kinds = [PROPER if k == BLANK else k for k in kinds]
    return " ".join(words), "".join(kinds)


HOLE = "H"
# Words that need another one behind them, and such as cannot be it
_GOVERN = frozenset("on at by for to of from in until with no em de do da para por até com no na en del con hasta von am um bis für mit im zum zur".split()) | _GREET
_LINK = frozenset("and or but should will was were is are e ou mas y o pero deve será foi debe fue und oder aber soll wird war ist".split()) | (_GOVERN - _GREET)


def holes(words: str, kinds: str) -> str:
    """The kinds, with H for a blank (B) behind a word that needs another one and before one that cannot be it, or the end."""
    if BLANK not in kinds or not words:
        return kinds
    w = words.split(" ")
    return "".join(HOLE if k == BLANK and i and w[i - 1] in _GOVERN and (i == len(w) or w[i] in _LINK) else k for i, k in enumerate(kinds))


# a field where a value has to stand: right after a greeting, or as all that follows a label
_OPEN_GREETING = re.compile(rf"^{_GREETS}(?: [^\W\d_]+)? [\x01\x02] ?(?:[,:!.;]|$)", re.I)
_OPEN_LABEL = re.compile(r"^[^\W\d_][\w ]{0,40}: ?\x01 ?[.,;]?$")
_NO_FIELD = re.compile(r"\b[Xx]{3,}\b|#\w+")  # hidden digits and channels
#: Marks that only template languages use.
_STRONG = re.compile(rf"\{{\{{\{{? ?{_NAME} ?\}}\}}\}}?|\$\{{ ?{_NAME} ?\}}|<%=? ?{_NAME} ?%>|\[\[ ?{_NAME} ?\]\]|<< ?{_NAME} ?>>|\*\|{_NAME}\|\*|%%[A-Za-z_]+%%|@@{_NAME}@@")
# What mails that speak about templates say
_ABOUT = re.compile(r"template|placeholder|variable|merge|\bfields?\b|\btags?\b|syntax|modelo|vari[áa]ve[li]|\bcampos?\b|plantilla|marcador|vorlage|platzhalter|\bfeld(?:er)?\b", re.I)


def open_fields(parts: list[tuple[str, bool, bool]]) -> list[bool]:
    """Which sentences have an unfilled field whatever other records hold there.

    That is a field right after a greeting, a field in a template language's
    marks that is all that follows a label, or any such field of a text with
    several of them. A text that speaks about templates or reports in the first
    person has none, nor have code and a line that is announced by a colon.
    """
    out = [False] * len(parts)
    if not any(_ANY_MARK.search(s) for s, _, _ in parts):
        return out
    own = [s for s, code, _ in parts if not code]
    if any(_ABOUT.search(t) or _REPORT.search(t) for t in (_EMPTY.sub(" ", _VARIABLE.sub(" ", s)) for s in own)):
        return out
    several = sum(len(_STRONG.findall(s)) for s in own) > 1
    announced = False
    for k, (s, code, _) in enumerate(parts):
        if not code and not announced:
            strong = _STRONG.search(s)
            marked = "" if _NO_FIELD.search(s) else " ".join(_EMPTY.sub(" \x02 ", _VARIABLE.sub(" \x01 ", s)).split(" ")).replace("  ", " ")
            out[k] = bool(strong and several or _OPEN_GREETING.match(marked) or strong and _OPEN_LABEL.match(marked))
        announced = s.endswith(":") and not _GREETING.match(s)
    return out


_ROW_SETS = tuple(map(frozenset, _ROWS))
# Common words whose letters all lie in one row
_IN_A_ROW = frozenset("i we you it to or our your were try per tu eu por pro tipo quer quero porque outro yo tuyo pero wo wie wir er euer a as has had all shall ask da das als falls sala fala".split())
# every page line holds one of the first, every demand for scripts one of the others, in lower case
_HINTS = (*_PAGE, "script", "js", "client-side", "secuencias de comandos", "skript", "cookies")


def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for w in words:
        found.add_word(w)
    found.make_automaton()
    return found


_HINT, _PLACE_PART = _automaton(_HINTS), _automaton(_PLACE_PARTS)


def _holds(text: str, words: ahocorasick.Automaton) -> bool:
    return next(words.iter(text), None) is not None


def _repeats(parts: list[str]) -> bool:
    """Up to three tokens, each four times or more on average."""
    return len(set(parts)) <= min(3, len(parts) // 4)


def hinted(own: str, parts: list[tuple[str, bool, bool]]) -> bool:
    """Whether any sentence of the text may be filler or a page's line: a cheap test that holds for every text in which labels() finds one."""
    low = own.lower()
    if _holds(low, _HINT) or _may_hold_place(own, low) and _PLACE.search(own) or any(c in own for c in _FOLDED):
        return True
    if ("4" in own or "5" in own) and any(_STATUS.match(s) for s, _, _ in parts if "4" in s or "5" in s):
        return True
    return any(_babble(s) for s, _, _ in parts)


def _may_hold_place(text: str, low: str) -> bool:
    return _holds(low, _PLACE_PART) or "TODO" in text or any(c in text for c in _FOLDED)


def is_filler(sentence: str) -> bool:
    """Lorem ipsum, keyboard mashing, one word over and over, or a phrase that only holds a text's place."""
    if _may_hold_place(sentence, sentence.lower()) and _PLACE.search(sentence) and len(_PLACE.sub("", _VARIABLE.sub("", sentence)).split()) <= max(1, len(_WORD.findall(sentence)) // 3):
        return True
    return _babble(sentence)


@lru_cache(1 << 16)
def _babble(sentence: str) -> bool:
    """Lorem ipsum, keyboard mashing, or one word over and over."""
    low = sentence.lower()
    words = _WORD.findall(low)
    if not words:
        return len(sentence) >= 12 and _repeats(sentence.split())
    if len(words) < 3:
        return False
    if sum(map(_LATIN.__contains__, words)) >= 0.6 * len(words):
        return True
    if len(words) >= 4 and _repeats(low.split()):
        return True
    letters = "".join(words)
    if len(letters) < 12 or len(set(letters)) > 14 or sum(any(r.issuperset(w) for r in _ROW_SETS) for w in words) < 0.9 * len(words):
        return False
    # neither one word numbered through nor a sentence that happens to lie in one row
    return (len(set(words)) > 1 or len(set(filter(str.isalnum, low))) <= 14) and len(_IN_A_ROW.intersection(words)) < 2


def labels(parts: list[tuple[str, bool, bool]]) -> list[str]:
    """What each sentence of a text is."""
    out: list[str] = []
    opening = True  # up to the greeting and one heading
    for k, (sentence, code, whole_line) in enumerate(parts):
        if opening and _GREETING.match(sentence):
            out.append(GREETING)
            continue
        out.append(_label(sentence, code, whole_line, opening, k < len(parts) - 1))
        opening = False
    return out


def opening(parts: list[tuple[str, bool, bool]]) -> int:
    """How many sentences greet before the text begins."""
    k = 0
    while k < len(parts) and _GREETING.match(parts[k][0]):
        k += 1
    return k


def bare(parts: list[tuple[str, bool, bool]]) -> bool:
    """Whether a text can be nothing but a page: no code, no quotation, nobody who speaks of themselves."""
    return bool(parts) and not any(code or "\x03" in s or _SPEAKER.search(s) for s, code, _ in parts)


def seeds(parts: list[tuple[str, bool, bool]], what: list[str]) -> bool:
    """Whether a text holds a line of known wording that may make it a page: filler, a line that stands alone, or one that may belong to a page
    - unless these are less than a third of the sentences (a full text of its own), someone reports in the first person, or it is shown as code.
    Nothing but likely lines is always a page."""
    if any(w in (SEED, FILLER) for w in what):
        return True
    if LIKELY not in what:
        return False
    if set(what) <= {LIKELY, GREETING}:
        return True
    shown = sum(w == LIKELY and not code for (_, code, _), w in zip(parts, what))
    return 0 < len(what) - what.count(GREETING) <= 3 * shown and not any(_REPORT.search(s) for s, _, _ in parts)


def _label(sentence: str, code: bool, whole_line: bool, first: bool, more: bool) -> str:
    if is_filler(sentence):
        return FILLER
    if _CHROME.match(sentence):
        return GREETING
    if "\x03" in sentence:
        return OTHER
    words, low = len(sentence.split()), sentence.lower()
    seed = (("4" in low or "5" in low) and _STATUS.match(sentence) is not None) or (_SCRIPT.search(sentence) and _DEMAND.search(sentence))
    likely = any(p in low for p in _PAGE)
    if words > 18 and (seed or likely) and _REPORT.search(sentence):
        seed = likely = False  # a long sentence that reports about a page
    if code and not (likely or seed):
        return CODE
    if seed and whole_line and not code:
        return SEED
    if seed or likely:
        return LIKELY if not (likely and whole_line and words <= 7 and not code) else SEED
    if first and more and whole_line and words <= 6 and not re.search(r"[.!?]$", sentence):
        return GREETING
    return GREETING if whole_line and _SIGNATURE.match(sentence) else OTHER
