"""What a notice says, by subject and predicate instead of by wording.

A sentence is reduced to the concepts that its words stand for, in English, German, French and
Spanish alike: things a site is made of, good and bad states, failures, refusals, scripts,
sessions, maintenance, advice to try again, stand-in text. It is a notice if the concepts form
one of the combinations below and hardly a word is left that is neither one of them nor a
function word; prose that touches on such matters has such words. There is no limit of length.
Words are compared by stem and without letters outside ASCII, as a wrong charset garbles those.
"""

from __future__ import annotations

import re
from functools import lru_cache

_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
_TOKEN = re.compile(r"[a-z0-9]+")

#: Stems of each concept; ``$`` marks a whole word.
_STEMS = {
    "thing": """page$ pages$ website site$ sites$ webpage content$ document$ documents$ resource file$ files$ url uri address$ link$ post$ article$ video$ image$ item$ account domain$ app$ apps$ application$ server$ servers$ gateway service$ services$ connection network database host$ location$ request$ requests$ requested
        seite$ seiten$ webseite homepage inhalt$ inhalte$ dokument$ datei adresse$ beitrag$ artikel$ konto$ dienst$ anwendung$ anfrage verbindung$ datenbank angebot$
        contenu$ contenus$ ressource fichier adresse lien$ compte$ serveur demande$ requête connexion$ données$ página sitio$ contenido$ documento$ recurso archivo dirección enlace artículo vídeo cuenta$ servidor servicio$ aplicación solicitud petición conexión datos$""",
    "neg": "not$ no$ never$ cannot unable nothing none$ without don$ doesn$ didn$ isn$ wasn$ couldn$ can$ won$ dont$ doesnt$ didnt$ isnt$ cant$ couldnt$ longer$ nicht$ kein$ keine$ keinen$ keiner$ nichts$ ohne$ ne$ n$ pas$ plus$ aucun$ aucune$ impossible rien$ sans$ ningún ninguna nada$ sin$ ya$ invalid incomplete",
    "good": """found$ find$ exist exists$ available accessible reachable reach reached displayed display shown show$ loaded load$ opened valid$ complete$ completed processed process$ respond responded supported work$ works$ function$ fulfil serve
        gefunden existiert existieren verfügbar erreichbar zugänglich angezeigt geladen geöffnet gültig bearbeitet bearbeiten verarbeitet verarbeiten unterstützt vorhanden antwortet funktioniert
        trouvé existe$ disponible affiché afficher$ affichée chargé ouvert valide$ traité traiter$ répond fonctionne encontrado encontrada encuentra encontrar existe disponible accesible mostrar cargado cargar$ válido procesar responde funciona""",
    "state": """missing$ gone$ removed deleted moved$ expired unavailable terminated suspended switched$ closed$ withdrawn disabled offline down$ broken$ dead$ ended$ outdated denied$ parked
        entfernt gelöscht verschoben abgelaufen gesperrt geschlossen ungültig deaktiviert unerreichbar beendet veraltet introuvable supprimé déplacé expiré indisponible suspendu fermé retiré désactivé invalide terminée$
        eliminad borrad movid caducad expirad suspendid cerrad retirad desactivad deshabilitad inválid terminado$""",
    "broke": """error$ errors$ failed failure fault$ wrong$ problem$ problems$ crash crashed timeout timed$ overloaded exception misconfigur misconfiguration interrupted reset$ refused trouble critical fatal
        fehler serverfehler fehlgeschlagen gescheitert überlastet abgestürzt störung unterbrochen ausnahmefehler erreur échec échoué problème surchargé panne$ interrompu fallo falló problema sobrecargad avería interrumpid incidencia""",
    "deny": """denied forbidden permission permissions authorized authorised authorization unauthorized unauthorised restricted blocked banned prohibited privileges rights$ allowed$ permitted
        verweigert verboten berechtigung berechtigt befugt gesperrt blockiert zugriffsrechte rechte$ refusé interdit autorisation autorisé bloqué restreint droit$ droits$ denegad prohibid permiso autorizad autorización bloquead restringid privilegios""",
    "access": "access accessing view$ viewing enter$ open$ see$ zugriff zugreifen zugang zuzugreifen öffnen aufrufen accès accéder consulter ouvrir acceso acceder abrir",
    "script": "javascript js$ script$ scripts$ scripting skript skripte skripten cookies$ cookie$",
    "browser": "browser browsers navigateur navegador",
    "enable": "enable enabled enabling activate activated turn$ turned switch$ allow$ permit$ aktivieren aktiviert aktiviere einschalten eingeschaltet erlauben zulassen activer activez activé activa$ active$ activar activado activada habilitar habilite habilitado autoriser autorisez permitir permita",
    "require": "require required requires need$ needs$ needed necessary must$ depends requirement benötigt benötigen erforderlich braucht nötig notwendig erfordert nécessaire nécessite requis requise exige besoin faut$ requiere requerido necesario necesita necesitan precisa",
    "session": "session$ sessions$ login$ password username credentials sitzung anmeldung passwort identifiant sesión contraseña",
    "login": "login$ logged$ log$ sign$ signed$ authenticate anmelden melden$ einloggen connecter reconnecter identifier$ connectez inicie$ iniciar identifíquese",
    "retry": """try$ trying retry again$ later$ reload refresh back$ return$ contact$ wait$ check$ visit$ versuchen versuche erneut später nochmal nochmals laden$ neu$ zurück warten wenden$ kontaktieren besuchen
        réessayer réessayez tard$ recharger rechargez actualiser actualisez revenir revenez retour$ patienter patientez contacter contactez intentar intentarlo inténtelo intente nuevo$ tarde$ recargar recargue volver$ vuelva actualizar actualice espere contacto$ contactar póngase regrese""",
    "who": "administrator admin$ webmaster owner$ provider support$ hosting team$ staff betreiber anbieter kundendienst administrateur webmestre hébergeur propriétaire assistance administrador propietario proveedor soporte",
    "maint": "maintenance upgrade upgraded upgrading updating construction downtime wartung wartungsarbeiten wartungsmodus umbau überarbeitet travaux$ mantenimiento obras$ actualización",
    "human": "human$ humans$ robot$ robots$ captcha verify verifying verification checking security$ attacks protect mensch$ roboter überprüfen überprüfung überprüft sicherheit humain vérifier vérification sécurité humano verificar verificación verifique seguridad",
    "limit": "limit$ limited$ limits$ exceeded exceed quota rate$ bandwidth many$ überschritten kontingent limite$ dépassé trop$ límite excedido excedida superado cuota demasiadas",
    "occur": "occurred encountered happened went$ looks$ aufgetreten passiert survenue survenu produite rencontrée ocurrido producido production",
    "code": "http https status nginx apache iis tomcat cloudflare openresty response internal interne interner interno",
    "polite": "sorry oops whoops please apologize apologies inconvenience unfortunately leider bitte entschuldigung entschuldigen désolé désolés veuillez malheureusement merci$ siento lamentamos disculpe disculpen favor",
    "time": "now$ moment$ minute$ minutes$ seconds$ second$ temporarily temporary currently momentarily soon$ shortly scheduled briefly derzeit momentan vorübergehend zurzeit augenblick$ minuten sekunden kürze bald$ actuellement temporairement instant$ bientôt momento actualmente temporalmente minutos segundos pronto$",
    "fill": "placeholder lorem ipsum dummy$ sample$ filler$ blindtext platzhalter mustertext beispieltext factice exemple$ relleno ejemplo$ example$",
    "unit": "text$ paragraph paragraphs heading title$ subtitle caption block$ button$ headline texte$ paragraphe titre$ absatz überschrift texto$ párrafo título",
    "replace": "replace insert add$ edit$ change$ click$ type$ write$ ersetzen einfügen bearbeiten ändern remplacer remplacez modifier modifiez insérez reemplace sustituya inserte edite cambie",
}
_FUNCTION = frozenset(
    _NON_ASCII.sub(
        "",
        """the a an and or of to in is are was were be been being has have had for on with as at by from that this these it its their our your you we i he she they them us me my will would may might should could must do does did which who what when where if than then so but because due
        there here only also just yet still very more most some any all every each own while until before after once out off up into over under about like one two few t s re ve ll d m using used use uses unless however itself properly full order view site wide own per via such same other another time
        die das der den dem des ein eine einen einem einer eines und oder aber ist sind war waren wird werden wurde wurden sein hat haben kann können konnte mit auf aus bei von vom zu zum zur für um im in an am als auch nur noch nach vor über unter sie ihr ihre ihren ihrem ihrer wir uns unser unsere es er sich man wenn dass diese dieser dieses diesem diesen hier mehr wegen durch mal einmal moment welche leider
        le la les l un une des du de d et ou mais est sont était a ont été être pour par sur dans en au aux avec ce cet cette ces c que qui quoi dont où il elle ils elles nous vous votre vos notre nos son sa ses leur si ne pas y se s à lors afin avoir
        el los las lo un una unos unas y o pero es son era está están ha han sido ser para por con del al en de que qui quien cual este esta esto estos estas ese esa su sus nuestro nuestra usted ustedes nos le les se si como más muy ya hoy a ante sobre puede pueden poder
        looking continue display displayed run running properly trying asked wanted different correct correctly work working new old following information feature features functionality experience version part parts website complete details detail name reason reasons cause possible following person people
        gesuchte gesuchten angeforderte angeforderten gewünschte suchen nutzen ordnungsgemäß fortfahren anzuzeigen anzeigen sehen gestellte möchten gerne recherchez cherchez recherchée demandée cherchée continuer utiliser voir affichage traitement bon fonctionnement busca buscada buscaba solicitada pedida continuar usar utilizar ver correctamente funcionamiento intenta""",
    ).split()
)
_CODE_NUMBER = re.compile(r"[45]\d\d$")


def _table() -> tuple[dict[str, set[str]], dict[str, set[str]]]:
    whole: dict[str, set[str]] = {}
    stem: dict[str, set[str]] = {}
    for concept, words in _STEMS.items():
        for w in words.split():
            plain = _NON_ASCII.sub("", w)
            at = whole if plain.endswith("$") or len(plain) < 4 else stem
            at.setdefault(plain.rstrip("$"), set()).add(concept)
    return whole, stem


_WHOLE, _STEM = _table()
_LONGEST = max(map(len, _STEM))


@lru_cache(maxsize=100_000)
def concepts_of(token: str) -> frozenset[str]:
    """Concepts of one word: the whole word, its longest known stem with at most four letters behind, or what an elided article leaves."""
    if token in _WHOLE:
        return frozenset(_WHOLE[token])
    for n in range(min(len(token), _LONGEST), 3, -1):
        if token[:n] in _STEM and len(token) - n <= 4:
            return frozenset(_STEM[token[:n]])
    if _CODE_NUMBER.match(token):
        return frozenset(["number"])
    if len(token) > 4 and token[0] in "nldsjmtc" and token[1] in "aeiouh":
        rest = token[1:]
        if rest in _WHOLE or any(rest[:n] in _STEM for n in range(4, len(rest) + 1)):
            return concepts_of(rest) | ({"neg"} if token[0] == "n" else frozenset())
    return frozenset()


def says(sentence: str) -> bool:
    """Is a squashed sentence a notice or stand-in text?"""
    tokens = _TOKEN.findall(sentence)
    if not tokens:
        return False
    found: dict[str, set[str]] = {}
    hits = known = 0
    for t in tokens:
        c = concepts_of(t)
        if c:
            hits += 1
            for x in c:
                found.setdefault(x, set()).add(t)
        elif t in _FUNCTION or t.isdigit():
            known += 1
    n = len(tokens)
    # a third of the words at least are concepts; a sixth will do where hardly any word is left over
    if hits + known < 0.8 * n or hits * 6 < n or (hits * 3 < n and hits + known < 0.95 * n):
        return False
    has = found.keys().__contains__

    def count(*names: str) -> int:
        return len(set().union(*(found.get(x, set()) for x in names)))

    bad = has("state") or (has("neg") and has("good"))
    if bad and (has("thing") or has("browser")):
        return True
    if has("broke") and (has("thing") or has("occur") or has("retry") or has("polite") or has("who") or has("number") or hits == n):
        return True
    if has("deny") and (has("access") or has("thing") or hits == n):
        return True
    if has("script") and (has("enable") or has("require") or has("state") or has("deny") or (has("neg") and has("good"))):
        return True
    if has("session") and (has("state") or has("login")) or (has("login") and (has("require") or (has("polite") and has("retry")))):
        return True
    if has("maint") and (has("thing") or has("retry") or has("time")):
        return True
    if has("human") and (count("human") >= 2 or has("browser") or has("access") or (has("thing") and has("polite")) or has("polite")):
        return True
    if has("limit") and (count("limit") >= 2 or has("thing") or has("retry")):
        return True
    if has("number") and (has("code") or has("neg") or has("state") or has("deny")):
        return True
    if has("retry") and (count("retry") >= 2 or has("who") or has("polite") or has("time")):
        return True
    if has("time") and has("polite") and hits == n:
        return True
    return has("fill") and (has("unit") or has("thing")) or (has("unit") and has("replace"))


#: Function words of Latin that mock text is full of.
_LATIN = frozenset("et in ut sed qui quae quod quas quos quis non ad ex est sunt cum ab aut nec vel si enim ipsa ipsum iste ipse eos id eum sit at hic nam nisi atque neque eaque illo illum ea tam quam sint veniam nulla".split())
_LATIN_END = re.compile(r"(?:um|us|is|it|at|or|et|ra|am|im|io|ant|ent|unt|en|re|da|ta|ur|em|ae|ia|a|o|i|as|os|es|ti|te|que|e)$")
#: Function words of the four languages that Latin has too.
_SHARED = _LATIN | frozenset("a de es se me per o".split())


def mock_latin(words: list[str], living: frozenset[str]) -> bool:
    """Six words or more with the endings of Latin, one in twelve a function word of it, none (but shared ones) of a living language."""
    if len(words) < 6 or any(w in living and w not in _SHARED for w in words):
        return False
    like = sum(w in _LATIN or bool(_LATIN_END.search(w)) for w in words)
    own = sum(w in _LATIN for w in words)
    return like >= 0.9 * len(words) and own * 12 >= len(words) and own >= 1
