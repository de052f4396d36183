"""Problem 9: template residue, filler, error pages and script notices instead of content.

A text is cut into lines and sentences; menus, cookie notices, link lists, footers and titles
are set aside. Each sentence left is judged by delimiter-specific grammars for unfilled
placeholders, by regular expressions for notices, and by the make-up of filler. Code blocks
and quoted wording are blanked first, so that tutorials and articles that mention such
wording keep their sentences. A document is a case if what is judged residue outweighs
whatever else it says.

Letters outside ASCII are dropped on both sides before matching, so that accents that a wrong
charset has garbled don't hide a notice.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import notice_grammar

_HIDDEN = re.compile(r"[\x00\u00ad\u034f\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_SPACES = re.compile(r"[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")


def squash(text: str) -> str:
    """Lower-case ASCII skeleton of a text."""
    return _NON_ASCII.sub("", _SPACES.sub(" ", text).lower())


# --- placeholders -----------------------------------------------------------
_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[._][A-Za-z0-9]+)*(?: [A-Za-z][A-Za-z0-9]*){0,2}"
#: The delimiters of common template languages, two-sign ones before one-sign ones.
DELIMITERS = (
    (r"\{\{\{?", r"\}?\}\}"), (r"\{%-?", r"-?%\}"), (r"<%[=-]?", r"-?%>"), (r"<\?=", r"\?>"), (r"\$\{", r"\}"), (r"#\{", r"\}"), (r"@@", r"@@"), (r"\[\[", r"\]\]"),
    (r"__", r"__"), (r"##", r"##"), (r"<<", r">>"), (r"\*\|", r"\|\*"), (r"«", r"»"), (r"%", r"%"), (r"#", r"#"), (r"\$", r"\$"), (r"\{", r"\}"), (r"\[", r"\]"), (r"<", r">"),
)
PLACEHOLDER = re.compile("|".join(rf"{a}\s?{_NAME}\s?{b}" for a, b in DELIMITERS))
_SIGNS = re.compile(r"[{}\[\]<>%@#$«»]|__")
#: Guillemets around a name that a wrong charset has made replacement characters.
_LOST_SIGNS = re.compile(r"(?<![A-Za-z\ufffd])\ufffd{1,2}([A-Za-z][A-Za-z0-9_.]{3,}(?: [A-Za-z]+)?)\ufffd{1,2}(?![A-Za-z\ufffd])")

# --- code and quotations ----------------------------------------------------
_CODE = re.compile(r"```.*?(?:```|\Z)|<pre\b.*?(?:</pre>|\Z)|<code\b.*?(?:</code>|\Z)|`[^`\n]{1,200}`", re.S | re.I)
_QUOTED = re.compile(r"“[^”\n]{1,200}”|„[^“”\n]{1,200}[“”]|«\s[^»\n]{1,200}\s»|‘[^’\n]{3,80}’(?!\w)")

# --- what is set aside ------------------------------------------------------
_MENU_WORD = r"""home|news|blog|shop|store|forum|team|press|events?|help|faq|contact|careers|jobs|gallery|products?|services|downloads?|search|archive|sign in|sign up|log ?in|log ?out|register|about(?: us)?
|startseite|aktuelles|anmelden|hilfe|kontakt|laden|archiv|termine|suche|über uns|produkte|impressum|datenschutz
|accueil|actualités|aide|boutique|recherche|connexion|événements|à propos|produits|mentions légales|confidentialité
|inicio|noticias|ayuda|contacto|tienda|búsqueda|iniciar sesión|quiénes somos|galería|productos|eventos|aviso legal|privacidad
|terms(?: of use)?|privacy(?: policy)?|imprint|legal(?: notice)?|settings|menu"""
_ASIDE = [
    r"(?:we use|this site (?:uses|stores)|our site uses) cookies\b.*", r"cookies help us\b.*", r"your privacy matters\b.*", r"by staying you agree\b.*", r"necessary only\b.*", r"(?:accept|reject|allow) all\b.*", r"got it!?",
    r"wir verwenden cookies\b.*", r"diese seite speichert cookies\b.*", r"alle annehmen\b.*", r"einverstanden\.?",
    r"nous utilisons des cookies\b.*", r"ce site (?:dépose|utilise) des cookies\b.*", r"tout accepter\b.*", r"d.?accord\.?",
    r"(?:usamos|utilizamos) cookies\b.*", r"este sitio (?:guarda|usa) cookies\b.*", r"aceptar todo\b.*", r"de acuerdo\.?",
    r"(?:\(c\)|copyright)\b.*", r".{0,120}all rights reserved\b.{0,120}", r"alle rechte bei\b.*", r"tous droits réservés\b.*", r"todos los derechos\b.*", r"terms of use\b.*", r"follow .{1,40} on the usual channels\b.*", r"\d{4} \S.{0,40}made with care\.?",
    r"made with care\.?", r"back to top\.?", r"zurück nach oben\.?", r"haut de page\.?", r"volver arriba\.?", r"mirror:? \S+", r"[\w-]+\.(?:test|example|invalid|com|org|net)",
]
_LIST_HEAD = [
    r"popular now:?", r"you may also like:?", r"(?:try|see) (?:these|this|also)(?: instead)?:?", r"related(?: articles| posts)?:?", r"read (?:also|more|next):?", r"vielleicht interessant:?", r"das könnte sie interessieren:?", r"lesen sie auch:?",
    r"à lire aussi\s?:?", r"à voir aussi\s?:?", r"quizá le interese:?", r"lea también:?", r"más leídos?:?", r"beliebt:?",
]

# --- notices ----------------------------------------------------------------
_SCRIPT = r"(?:java ?scripts?|scripts?|scripting|skripte?)"
_ON = r"(?:enabled?|activated?|switch(?:ed)? on|turn(?:ed)? on|allow(?:ed)?|permit(?:ted)?)"
_THING = r"(?:page|pages|site|website|content|document|resource|folder|file|area|address|link|url|post|entry|listing|offer|item|account|domain|article|video|app|application|viewer|tool|service|shop|store|map|form|player)"
_NOTICE = [
    # not there
    r"(?:error\s*)?4\d\d(?:\s*[-:]?\s*(?:not found|forbidden|error|unauthorized|gone|bad request|too many requests|page not found))?[.!]?$", r"(?:error\s*)?5\d\d(?:\s*[-:]?\s*\w+(?: \w+){0,3})?[.!]?$",
    r"(?:error|fehler|erreur) ?(?:code)?:? ?\d*[.!]?$", r"not found[.!]?$", rf"(?:sorry,? |oops,? |uh-oh,? )?(?:the|this|that|your)?\s?(?:requested |linked |chosen |old )?{_THING}(?: you (?:asked for|requested|want(?:ed)?|are looking for))? (?:(?:was|is|has been|could|can|cannot|does|did|has|never|no longer|may have|seems)\b.{{0,30}}(?:not found|not exist|exists?\b|existed|gone|moved|removed|deleted|missing|not here|be found|expired|unavailable|taken down|not available|withdrawn|closed|locked|suspended|switched off|disabled|parked|blocked|available|online)|not found)\b.{{0,60}}$",
    r"it seems (?:that |this |the |what ).{0,60}$", r"(?:whoops|lost)[.!?]*$", r"(?:php )?(?:warning|notice)?:? ?call to undefined\b.{0,80}$", r"we (?:looked everywhere|can(?:no|')t find|could not find|couldn.?t find)\b.{0,80}$", r"(?:sorry,? )?nothing (?:here|found|to show|matched)\b.{0,40}$", r"no (?:results?|matches|items|entries|hits)(?: found)?\b.{0,40}$", r"page not found\b.{0,40}$", r"(?:lost|dead|broken) (?:page|link)\.?$",
    r"your (?:search|query|filter|request)\b.{0,20}(?:gave|matched|returned|found|has) (?:nothing|no \w+)\.?$", r"0 items (?:shown|found)\.?$", r"check the (?:spelling|address|link|url)\b.{0,40}$", r"try (?:searching|browsing|again|another|a different|other)\b.{0,40}$", r"(?:domain|site) (?:parked|disabled|closed|for sale)\.?$", r"account (?:suspended|disabled|closed)\.?$", r"(?:listing|post|entry|offer|page|item) (?:removed|expired|deleted|withdrawn|moved|gone)\.?$",
    # broke
    r"(?:\d+ )?(?:internal )?server (?:error|fault)\b.{0,40}$", r"(?:the|our) (?:server|system|site|service|application|app|back ?end|upstream)\b.{0,40}(?:failed|hit a snag|met a problem|error|gave up|did not|could not|closed the connection|sent an invalid|not respond|overloaded|unavailable|is down|busy)\b.{0,60}$",
    r"(?:an? )?(?:unexpected |unknown |internal |fatal )?(?:error|exception|problem)(?: has)?(?: occurred| happened)?\b[.:!]?(?: please try again.{0,20})?$", r"something (?:went wrong|broke)\b.{0,40}$", r"that did not work\b.{0,20}$", r"(?:oops|uh-oh|sorry)[.!]*$", r"(?:please )?(?:try|come|check) (?:again|back)\b.{0,40}$", r"(?:our )?staff (?:have|has) been (?:told|notified)\.?$", r"tell support\.?$", r"wait \d* ?(?:a )?\w* ?and retry\.?$", r"(?:please )?(?:reload|refresh)\b.{0,40}$", r"go back\b.{0,30}$",
    r"service (?:temporarily )?(?:unavailable|down)\b.{0,30}$", r"bad (?:gateway|request)\b.{0,20}$", r"gateway time-?out\b.{0,20}$", r"(?:database|db|sql) (?:connection )?(?:failed|error|fault)\b.{0,80}$", r"could not connect\b.{0,100}$", r"too many (?:requests|connections)\b.{0,100}$", r"(?:lost|no) (?:link|connection) to (?:the )?(?:server|database)\b.{0,100}$", r"unknown host\b.{0,100}$", r"access denied for\b.{0,100}$", r"rate limit\b.{0,40}$", r"slow down\.?$", r"you have (?:reached|exceeded|hit) (?:the|your)\b.{0,30}limit\b.{0,20}$", r"you (?:have sent|sent|are sending) too many\b.{0,30}$",
    r"(?:unhandled|uncaught|fatal) (?:exception|error)\b.{0,100}$", r"(?:php )?(?:warning|notice|fatal error)\b:? (?:uncaught|undefined|call|bad|unknown|too many|lost)\b.{0,100}$", r"undefined (?:index|variable|offset|function)\b.{0,100}$", r"call on null\b.{0,60}$", r"bad id\b.{0,40}$", r"stack ?trace\b.{0,80}$", r"traceback\b.{0,80}$", r"(?:at |in )?file \W?/\S+.{0,120}$", r"\w*(?:error|exception): .{0,100}$", r"(?:in |at )?/(?:srv|var|usr|home|opt|app)/\S+.{0,80}$",
    r"(?:ray|reference|incident|trace|trace id|code|error code|kennung|código|código de error|request id|référence|incidente|referencia|id|fehlercode|code d.erreur)\W{0,3}#?[0-9a-f]{1,16}\W{0,2}$",
    # away
    r"(?:we(?: are|'re|’re)|this site is|the site is|site) (?:offline|down|closed|being updated|updating|under maintenance|in maintenance|undergoing)\b.{0,80}$", r"(?:we|it) will be (?:back|right back|available)\b.{0,40}$", r"(?:we(?: will|'ll)? )?be right back\b.{0,20}$", r"(?:under|scheduled) (?:maintenance|construction)\b.{0,30}$", r"come back (?:in|later|soon|at)\b.{0,30}$",
    # no entry
    r"(?:your )?(?:session|login|log-in)(?: has)? (?:ended|expired|timed out)\b.{0,30}$", r"logged out\.?$", r"(?:please )?(?:log|sign) in(?: again)?(?: required)?(?: (?:to|and|before)\b.{0,50})?[.!]?$", r"(?:log-?in|sign-?in) required\b.{0,20}$", r"(?:access|entry) (?:denied|forbidden|refused|restricted)\b.{0,30}$", r"restricted area\b.{0,20}$", r"forbidden\.?$", r"you (?:do not have|don.?t have|lack|are not allowed|have no|need) (?:the )?(?:permissions?|rights?|access|to see|to view|to open|authorization)\b.{0,60}$", r"ask the (?:owner|admin|administrator)\b.{0,40}$", r"(?:members|subscribers) only\.?$",
    # scripts
    rf"(?:please |kindly |to continue,? |you (?:must|need to|have to|should) |must |then )*{_ON} (?:java ?script|scripts?|scripting|them|cookies)\b.{{0,80}}$", rf".{{0,60}}\b(?:needs?|requires?|depends on|relies on|uses|must have|wants) {_SCRIPT}\b.{{0,60}}$", rf".{{0,60}}\b(?:does|do|will|can) ?not (?:work|run|load|function|open|display|start)\b.{{0,30}}(?:without|unless|until) {_SCRIPT}\b.{{0,40}}$", rf"you (?:need|have|must)(?: to)? (?:have )?{_SCRIPT} .{{0,60}}$", rf"{_SCRIPT}(?: and cookies)? (?:must|need to|have to|should|are|is|has to)\b.{{0,60}}$", rf"(?:it looks like |it seems )?(?:your|this) browser\b.{{0,40}}(?:{_SCRIPT}|not supported|the code)\b.{{0,60}}$", r"turn (?:them|it) on\b.{0,50}$", r"(?:please )?keep scripts on\b.{0,20}$", r"adjust your (?:browser )?settings\b.{0,20}$", r"loading\.*$", rf"if nothing happens\b.{{0,60}}$", r"verify (?:that )?you are (?:a )?human\b.{0,40}$", r"checking your browser\b.{0,60}$", r"this may take\b.{0,30}$", rf"(?:without|no) {_SCRIPT}\b.{{0,20}}(?:this|the) (?:page|site).{{0,40}}$",
    # German
    r"(?:die )?(?:angeforderte |gewünschte |gesuchte |verlinkte )?(?:seite|adresse|datei|inhalt|anzeige|eintrag)\b.{0,20}(?:nicht gefunden|existiert nicht|gibt es nicht|wurde verschoben|wurde entfernt|wurde gelöscht|nicht mehr|nicht verfügbar|nicht erreichbar)\b.{0,30}$", r"(?:seite )?nicht gefunden[.!]?$", r"(?:leider )?(?:ist )?(?:ein )?(?:interner |unerwarteter )?(?:server)?fehler\b.{0,40}$", r"(?:bitte )?(?:versuchen sie es )?später (?:erneut|noch einmal|wieder)\b.{0,30}$", r"wir sind (?:bald|in kürze|gleich|kurz)\b.{0,40}$", r"(?:in |wegen )?wartung(?:sarbeiten|smodus)?\b.{0,40}$", r"zugriff (?:verweigert|gesperrt|verboten)\b.{0,20}$", r"(?:sie haben )?keine (?:rechte|berechtigung|ergebnisse|treffer|zugriffsrechte)\b.{0,40}$", r"bitte (?:melden sie sich|anmelden)\b.{0,40}$", rf"(?:bitte )?(?:aktivieren|erlauben|schalten)\b.{{0,12}}(?:{_SCRIPT}|diese)\b.{{0,60}}$", rf".{{0,40}}\b(?:benötigt|braucht|erfordert|setzt) {_SCRIPT}\b.{{0,40}}$", r"bitte (?:zulassen|neu laden|einschalten)\.?$", r"(?:ihre )?sitzung (?:ist )?(?:abgelaufen|beendet)\b.{0,30}$", rf"(?:ihr )?browser\b.{{0,30}}{_SCRIPT}\b.{{0,40}}$",
    # French
    r"(?:la |cette )?page (?:demandée|recherchée|voulue|introuvable)?\b.{0,12}(?:n.?existe pas|n.?est plus|a été|introuvable|n.?existe plus|est introuvable)\b.{0,40}$", r"page introuvable[.!]?$", r"(?:erreur|incident)(?: interne| serveur| du serveur| inattendue)?[.!]?$", r"une erreur\b.{0,40}$", r"(?:veuillez )?réessay(?:er|ez)\b.{0,30}$", r"nous revenons\b.{0,40}$", r"(?:site )?en (?:travaux|maintenance|construction)\b.{0,30}$", r"accès (?:refusé|interdit)\b.{0,20}$", r"vous n.?avez pas (?:le droit|la permission|les droits|accès)\b.{0,50}$", rf"(?:veuillez |merci d.?)?(?:activer|autoriser|activez|autorisez)\b.{{0,6}}(?:java ?script|(?:les )?scripts)\b.{{0,60}}$", rf".{{0,40}}\b(?:exige|requiert|nécessite|demande|utilise) (?:des |les )?{_SCRIPT}\b.{{0,40}}$", r"autorisez-les\b.{0,40}$", r"(?:votre )?session\b.{0,12}(?:expiré|terminée)e?\b.{0,20}$", r"aucun (?:résultat|élément)\b.{0,30}$", r"(?:veuillez vous )?(?:re)?connecte[rz]\b.{0,40}$",
    # Spanish
    r"(?:la |esta )?página (?:pedida|solicitada|buscada|no encontrada)?\b.{0,8}(?:no existe|no encontrada|ha cambiado|ya no|no se encuentra|no está|fue)\b.{0,40}$", r"página no encontrada[.!]?$", r"(?:error|fallo)(?: interno)?(?: del? servidor)?(?: inesperado)?[.!]?$", r"ha ocurrido un\b.{0,30}$", r"(?:por favor,? )?inténtelo\b.{0,30}$", r"volveremos\b.{0,30}$", r"(?:sitio )?en (?:obras|mantenimiento|construcción)\b.{0,20}$", r"acceso (?:denegado|prohibido|restringido)\b.{0,20}$", r"no tiene (?:permiso|derecho|acceso|autorización)\b.{0,50}$", rf"(?:por favor,? )?(?:active|habilite|permita)\b.{{0,6}}(?:java ?script|(?:los )?scripts)\b.{{0,60}}$", rf".{{0,40}}\b(?:requiere|necesita|exige|usa) (?:los )?{_SCRIPT}\b.{{0,40}}$", r"permítalos\b.{0,40}$", r"(?:su )?sesión\b.{0,12}(?:caducado|expirado|terminado|terminada|caducada)\b.{0,20}$", r"(?:sin|no hay|ningún) (?:resultados?|elementos)\b.{0,20}$",
]

# --- filler -----------------------------------------------------------------
_BLANK = r"(?:dummy|example|demo|sample|placeholder|filler|test)"
_UNIT = r"(?:text|copy|content|paragraph|block|line|section|words|message|story|title|heading|headline|caption|quote|picture|image|tagline|subtitle|box|item|offer)"
_FILLER = [
    r"lorem ipsum\b.*", rf"(?:this is |here is |some )?{_BLANK} {_UNIT}\b.{{0,60}}$", rf"(?:your|our|my) {_UNIT} (?:goes|belongs|comes|here|will go)\b.{{0,20}}$", rf"(?:replace|overwrite|swap|change|edit) (?:this|the) {_UNIT}\b.{{0,50}}$", r"(?:double-)?click (?:me|here|edit|this|the|to)\b.{0,40}$", r"double-click me\.?$", r"edit me\.?$", r"(?:write|say|tell) (?:something|a few (?:lines|words))\b.{0,40}$", r"describe your \w+\b.{0,40}$", rf"(?:add|insert|put|place) (?:a|an|your) {_UNIT}(?: here)?\.?$", r"(?:page|section|site) (?:sub)?(?:title|tagline|heading|headline)(?: here)?\.?$", r"heading (?:one|two|three|four|\d|goes here|here)\.?$", r"item \d+(?: (?:label|description|title|text))?\.?$", r"(?:more|content|page|text)?\s?coming (?:soon|shortly)\.?$", r"title goes here\.?$",
    r"(?:hier steht |dies ist |das ist )?(?:ein )?(?:beispieltext|mustertext|blindtext|platzhalter(?:text)?)\b.{0,30}$", r"(?:ändern|ersetzen) sie diesen? (?:absatz|abschnitt|text)\b.{0,50}$", r"(?:inhalt|text|mehr) folgt\b.{0,20}$", r"ihre? (?:überschrift|bildzeile|text|inhalt|titel|botschaft|nachricht)\b.{0,8}hier\.?$",
    r"ceci est un (?:faux texte|texte d.?exemple|texte factice)\b.{0,20}$", r"(?:modifiez|remplacez|changez) ce (?:paragraphe|texte|bloc)\b.{0,40}$", r"contenu (?:bientôt|à venir)\b.{0,20}$", r"titre de la (?:page|section)\.?$", r"votre (?:texte|message|titre|contenu) ici\.?$",
    r"este es un texto de (?:relleno|ejemplo|muestra|prueba)\b.{0,20}$", r"(?:cambie|sustituya|reemplace|modifique) este (?:párrafo|texto|bloque)\b.{0,40}$", r"contenido (?:en preparación|próximamente)\b.{0,20}$", r"su (?:lema|texto|mensaje|título|contenido) va aquí\.?$", r"título de (?:ejemplo|la sección|la página)\.?$", r"texto de (?:relleno|ejemplo)\.?$",
]


def _any(patterns: list[str]) -> re.Pattern:
    return re.compile("|".join(f"(?:{_NON_ASCII.sub('', p)})" for p in patterns))


_RE_ASIDE, _RE_LIST, _RE_NOTICE, _RE_FILLER = (_any(p) for p in (_ASIDE, _LIST_HEAD, _NOTICE, _FILLER))
_MENU = _NON_ASCII.sub("", _MENU_WORD.replace("\n", ""))
_RE_MENU = re.compile(rf"(?:(?:{_MENU})(?:[\s|/>·•-]+|$))+$")
_MENU_PARTS = frozenset(re.findall(r"[a-z]{3,}", _MENU)) | {"in", "us", "uns"}
#: Short function words of the four languages; prose has some in every sentence, filler has none.
FUNCTION_WORDS = frozenset(
    """the a an and or of to in is are was were for on with as at by from that this it its their our no not so but which who when where why how each every some any both neither nor
    der die das und oder ein eine einer eines den dem des im in ist sind war für auf mit als von zu nicht sie er es wir aus bei nach seit ihre sein jede jeder keine warum weil
    le la les un une des et ou de du en est sont pour sur avec par qui que dans au aux ne pas sa son ses leur chaque il elle se ce cette
    el los las una y o del al es son para con por su sus cada se lo este esta en como más ya""".split()
)
_WORD = re.compile(r"[a-z0-9]+(?:['’][a-z]+)?")
_SENTENCE = re.compile(r"(?<=[.!?:…])\s+")
_LATIN_END = re.compile(r"(?:um|us|is|it|at|or|et|ra|am|im|io|ant|en|re|da|ta|ur|em|a|o)$")
#: At least one of these words is in any notice or filler phrase above; a cheap first test.
_TRIGGERS = frozenset(
    _NON_ASCII.sub(
        "",
        """error errors errore fehler serverfehler erreur fallo not found nicht gefunden exist exists existed existe existiert gone moved removed removido expired unavailable available server system upstream wrong work works
    reload refresh service gateway database db sql connect connection connections requests request limit exceeded undefined null trace stack traceback file srv ray reference incident code kennung código id référence incidente referencia fehlercode
    maintenance construction updated updating offline down session login logged log sign access entry restricted forbidden rights permission permissions allowed lack owner administrator script scripts javascript scripting skript skripte browser settings
    loading nothing human seems seite adresse verschoben entfernt später wartung zugriff rechte berechtigung ergebnisse treffer sitzung bitte kürze bald gleich page demandée introuvable réessayer réessayez revenons travaux accès droit droits permissions veuillez autorisez
    résultat connecter página pedida solicitada ocurrido inténtelo volveremos obras mantenimiento acceso permiso active habilite permita permítalos sesión resultados lorem dummy example demo sample placeholder filler test text copy content paragraph block
    section click edit write something describe heading item coming title subtitle tagline beispieltext mustertext blindtext platzhalter absatz abschnitt inhalt folgt überschrift bildzeile hier faux texte exemple dexemple factice modifiez remplacez changez contenu titre votre
    texto relleno ejemplo muestra párrafo contenido lema mensaje título oops uh whoops sorry check spelling searching browsing slow staff support suspended parked disabled closed locked account domain listing post offer shown results matched gave missing lost
    back retry wait minutes come again reached denied refused verweigert gesperrt refusé interdit denegado prohibido aplicación application anwendung caption quote picture story message words exception warning notice bad unknown required turn keep adjust verify checking
    looked everywhere dead broken 404 403 401 410 500 502 503 504 429 0 takes take seconds host password registrar call""",
    ).split()
)


def _is_filler(w: list[str]) -> bool:
    """Repeated tokens, or words without any function word and with endings of mock Latin."""
    if len(w) >= 5 and len(set(w)) <= max(1, len(w) // 6):
        return True
    if len(w) < 6 or any(x in FUNCTION_WORDS for x in w):
        return False
    return sum(bool(_LATIN_END.search(x)) for x in w) >= 0.85 * len(w)


def _is_menu(flat: str) -> bool:
    """A row of links: known menu words only, or mostly, or several separated entries without a sentence."""
    if _RE_MENU.match(flat):
        return True
    if len(flat) > 300 or flat[-1] in ".!?":
        return False
    w = _WORD.findall(flat)
    if flat.count("|") >= 2 and len(w) <= 5 * (flat.count("|") + 1):
        return True
    return len(w) >= 4 and sum(x in _MENU_PARTS for x in w) >= 0.6 * len(w)


@lru_cache(maxsize=200_000)
def _judge(sentence: str) -> str:
    """'residue', 'aside' or 'content' for one squashed sentence."""
    s = sentence.strip(" \t-*•=>|.:;,\"'()").strip() or ""
    w = _WORD.findall(s)
    if not w:
        return "aside"
    if _RE_ASIDE.fullmatch(s):
        return "aside"
    if _is_filler(w) or notice_grammar.mock_latin(w, FUNCTION_WORDS):
        return "residue"
    if not _TRIGGERS.isdisjoint(w) and (_RE_NOTICE.match(s) or _RE_FILLER.match(s)):
        return "residue"
    return "residue" if notice_grammar.says(s) else "content"


def weigh(text: str) -> dict[str, int]:
    """Words of residue (errors, notices, filler), of template sentences and of content, and unfilled placeholders."""
    out = {"residue": 0, "template": 0, "content": 0, "placeholders": 0}
    text = _HIDDEN.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    text = _CODE.sub(" quoted code ", text) if "`" in text or "<pre" in text.lower() or "<code" in text.lower() else text
    if "\ufffd" in text:
        text = _LOST_SIGNS.sub(r"«\1»", text)
    in_list = False
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        flat = squash(line).strip()
        if not flat:
            continue
        bare = flat.replace("»", " ").strip()
        if _is_menu(bare) or (len(flat) <= 300 and _RE_ASIDE.fullmatch(flat)):
            continue
        if _RE_LIST.fullmatch(flat):
            in_list = True
            continue
        n = len(_WORD.findall(flat))
        ends = line[-1] in ".!?…:;”\"')"
        if n <= 5 and not ends and not _SIGNS.search(line):
            # a title or a link, unless it is a notice in itself
            if _judge(flat) == "residue":
                out["residue"] += n
            continue
        if in_list and not ends:
            continue
        in_list = False
        # quoted wording is spoken about, not said
        line = _QUOTED.sub(" quoted words here ", line)
        for s in _SENTENCE.split(line):
            if _SIGNS.search(s):
                names = PLACEHOLDER.findall(s)
                rest = len(_WORD.findall(squash(PLACEHOLDER.sub(" ", s))))
                if names and rest <= 7 * len(names):
                    out["placeholders"] += len(names)
                    out["template"] += rest + 2 * len(names)
                    continue
            q = squash(s).strip()
            v = _judge(q)
            if v != "aside":
                out[v] += len(_WORD.findall(q))
    return out


def verdict(text: str) -> str | None:
    """'residue', 'template' or None."""
    w = weigh(text)
    bad = w["residue"] + (w["template"] if w["placeholders"] >= 3 else 0)
    other = w["content"] + (0 if w["placeholders"] >= 3 else w["template"])
    if not bad or bad < 2 * other:
        return None
    return "template" if w["placeholders"] >= 3 and w["template"] >= w["residue"] else "residue"


def residue_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind of every document whose main text is template residue, filler, an error or a notice.

    Null ids, null, empty and blank texts are not cases; documents are judged one by one and
    whole, so repeated rows repeat their verdict.
    """

    def run(batches):
        for b in batches:
            ids, kinds = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = verdict(t)
                if k:
                    ids.append(i)
                    kinds.append(k)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], names=["doc_id", "kind"])

    src = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null and t is not null and t <> ''")
    return src.mapInArrow(run, "doc_id long, kind string")
