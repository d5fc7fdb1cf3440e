"""Documents with template residue, filler text, error messages or script notices in place of content.

Texts are cut into lines and sentences; numbers, addresses and dates are masked; equal masked messages are grouped by an exact
hash, with their numbers of distinct documents and of sources. Each distinct message is judged once, by its wording and by how widely it recurs:
placeholders, filler and the phrases of errors and notices count wherever they stand; a message that only has a word
of trouble or a weak sign counts where it recurs in many documents of several sources. Messages that name, quote or discuss such
texts are told apart by their own wording.

Most messages hold no sign of any rule and are never masked or sent on. The signs are derived from the rules: :func:`signs` reads
each pattern and gives strings of which every match holds one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsidora.session import settle

# Phrases of filler, errors and notices, in lower case after masking (numbers are 0, status codes of errors <code>).

#: Unfilled fields, by the signs around them; a field may stand anywhere in a message.
FIELDS = (
    r"\{\{ ?[\p{L}\d_. ]+ ?\}\}",
    r"\$\{[\p{L}_][\p{L}\d_. ]*\}",
    r"\$\[[\p{L}_][\p{L}\d_. ]*\]",
    r"\$\([\p{L}_][\p{L}\d_. ]*\)",
    r"<%[=-]? ?[\p{L}\d_. ]+ ?%>",
    r"%%[\p{L}_][\p{L}\d_. ]*%%",
    r"@@[\p{L}_][\p{L}\d_. ]*@@",
    r"##[\p{L}_][\p{L}\d_. ]*##",
    r"(?<![\p{L}\d])__\p{Lu}[\p{Lu}_. ]*__(?![\p{L}\d])",
    r"<<[\p{L}_][\p{L}\d_. ]*>>",
    r"«[\p{L}_][\p{L}\d_. ]*»",
    r"%\([\p{L}_][\p{L}\d_. ]*\)[sd]",
    r"(?<![\p{L}\d%])%[sd](?![\p{L}\d])",
    r"(?<![\p{L}\d\]\)}])\{\d\}",
    r"(?<![\p{L}\d$%{])\{[\p{L}_][\p{L}_. ]*\}(?!\})",
    r"(?<![\p{L}\d$\[])\[\p{Lu}[\p{Lu}_. ]{2,}\](?!\])",
    r"(?<![\p{L}\d$\[])\[[\p{Ll}_][\p{Ll}_.]{2,}\](?!\])",
    r"\[\[ ?[\p{L}_][\p{L}\d_. ]* ?\]\]",
    r"(?i)\[object object\]",
    r"(?iu)[\[<][\p{L}\d_. ]+ (?:here|ici|aquí|hier)[\]>]",
    r"(?iu)[\[<](?:hier|aquí|ici|insert|enter|add) [\p{L}\d_. ]+[\]>]",
    r"\bTODO: ?\p{L}",
    r"(?iu)\([\p{L}\d_. ]+ (?:to be (?:added|filled in|supplied|completed)|à compléter|por completar|(?:noch )?(?:einzufügen|zu ergänzen|nachzutragen)|wird ergänzt|ergänzen)\)",
    r"(?<![\p{L}\d])X{5,}(?![\p{L}\d])",
    r"(?i)(?<!is |are |was |were |be |remains |still |currently )\bundefined\b",
    r"(?i)\b(?:is|are|was|were) undefined,? (?:an? |the |of |to )",
)
#: Messages that discuss, quote or compute with such signs.
ABOUT_FIELDS = r"(?iu)\b(?:exporter|template|templates|placeholder|placeholders|parser|formats?|notation|pattern|syntax|regex|vorlagen?|platzhalter|gabarits?|plantillas?|marcadores?)\b|\bin the shell |\bfor \w+ in \S+; do "

#: Filler; a whole message.
FILLER = (
    r"x{3,}(?: x{3,})*|tbd|tba|tbc|fixme|\?{3,}|n/a(?: n/a)+",
    r"(?:title|text|caption|description|content|name|heading|subtitle|summary|body) (?:goes|comes) here",
    r"(?:your|votre|ihre?|su|tu) (?:title|text|name|summary|headline|description|content|résumé|texte|titre|zusammenfassung|titel|resumen|título|texto) (?:here|goes here|ici|hier|aquí)",
    r"(?:sample|placeholder|dummy|filler|example) (?:text|content|copy)(?: goes here| for layout only| only)?",
    r"(?:this|here) is (?:dummy|placeholder|sample|filler) (?:text|content|copy).*",
    r"body copy (?:pending|to follow|goes here)|copy to follow|content (?:pending|to follow|coming soon)|coming soon|text to follow",
    r"(?:text|texte|texto) (?:text|texte|texto)(?: (?:text|texte|texto))+",
    r"(?:please )?replace this (?:paragraph|text|section|sentence)(?: later| with .*| before .*)?",
    r"this (?:paragraph|text|section) will be replaced(?: later)?",
    r"hier (?:steht|kommt|folgt) (?:später|bald|noch) (?:der|ein|die) (?:text|inhalt|zusammenfassung)|(?:dies|das|hier) ist (?:nur )?(?:ein )?(?:blindtext|platzhaltertext|fülltext|beispieltext).*|(?:blindtext|platzhalter|platzhaltertext|fülltext|beispieltext|mustertext)(?: für .*)?|bitte diesen (?:absatz|text) (?:später )?ersetzen|dieser (?:absatz|text) wird (?:später|noch) ersetzt|inhalt folgt(?: in kürze)?|text folgt",
    r"(?:ceci est un )?texte (?:factice|d'exemple|de remplissage|provisoire|fictif|temporaire)(?: pour .*)?|ce (?:paragraphe|texte) sera remplacé(?: plus tard)?|(?:veuillez )?remplace[rz] ce (?:paragraphe|texte).*|contenu à venir|texte à venir",
    r"(?:este es un )?texto (?:provisional|de relleno|de ejemplo|de muestra|simulado|ficticio|temporal)(?: para .*)?|este (?:párrafo|texto) se (?:sustituirá|reemplazará|cambiará)(?: más (?:tarde|adelante)| después)?|(?:sustituya|reemplace|sustituir|reemplazar) este (?:párrafo|texto).*|contenido (?:pendiente|próximamente)|aquí (?:va|irá|vendrá) (?:luego )?(?:el|un) (?:texto|resumen|título).*",
)
#: Words of the usual pseudo-Latin filler, which is cut from one old text and widened by generators, and of keyboard filler.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum perspiciatis unde omnis iste natus accusantium doloremque "
    "laudantium vestibulum pellentesque curabitur praesent aenean vivamus maecenas suspendisse phasellus quisque donec mauris morbi fusce etiam proin augue libero tempus ultrices ultricies faucibus fermentum egestas dictum sagittis malesuada facilisi facilisis "
    "consectetuer vulputate tincidunt venenatis scelerisque condimentum dignissim hendrerit imperdiet lobortis porttitor sollicitudin tristique volutpat aliquam aliquet bibendum blandit euismod fringilla habitant iaculis lacinia luctus mattis nibh nisl rhoncus sodales"
)
KEYS = "foo bar baz qux test asdf qwer qwerty blah abc xxx lorem dummy hjkl"
#: Words without which hardly a sentence of the four languages does; filler has none of them but those of its own text.
JOINTS = (
    "the of and to is was were are with for from by on at as that this which has have be not no than it its "
    "der die das und ist war mit für von im den dem des ein eine einer auf zu nicht als bei sich wird wurde sind "
    "le la les des du un une et est dans par pour que qui sur avec au aux ne pas ce cette il elle sont "
    "el los las de del una y es en con por para se al lo como su no fue son o"
)

#: Errors of servers and programs: headings and reasons; a whole message, or parts of one.
ERRORS = (
    r"(?:http )?(?:error|status|code|fehler|erreur|estado|statut) ?:? ?<code>(?: (?:not found|forbidden|bad gateway|bad request|unauthorized|gone|internal server error|service unavailable|gateway time-?out|too many requests|request time-?out|method not allowed).*)?|<code> (?:not found|forbidden|bad gateway|bad request|unauthorized|gone|internal server error|service unavailable|gateway time-?out|too many requests|request time-?out|method not allowed).*",
    r"(?:bad gateway|gateway time-?out|internal server error|server error|access denied|permission denied|forbidden|not found|page not found|page unavailable|timeout|timed out|request failed|request timed out|service (?:temporarily )?unavailable|service (?:is )?(?:currently|temporarily) unavailable|oops|something went wrong|unauthorized|bad request|too many requests|application error|database error|connection (?:refused|reset|timed out))",
    r"(?:serverfehler|interner serverfehler|zugriff verweigert|nicht gefunden|seite nicht gefunden|seite nicht verfügbar|zeitüberschreitung|anfrage fehlgeschlagen|verboten|etwas ist schiefgelaufen)",
    r"(?:erreur (?:du |interne du )?serveur|accès refusé|interdit|introuvable|page introuvable|page indisponible|délai dépassé|échec de la requête|requête échouée|une erreur est survenue|service indisponible)",
    r"(?:error (?:interno )?del servidor|acceso denegado|prohibido|no encontrad[oa]|página no (?:encontrada|disponible)|tiempo (?:de espera )?agotado|solicitud fallida|petición fallida|algo (?:ha ido|salió) mal|servicio no disponible)",
    r"(?:we could not|we couldn't|we can't|we cannot|unable to) (?:load|find|display|open|show|process) (?:this|that|the) (?:record|page|entry|view|content|request).*",
    r"(?:this|the) (?:entry|page|record|content|view|resource) could not be (?:displayed|loaded|found|shown|opened)",
    r"(?:the )?maintenance is under way until .*|(?:the )?(?:site|service|server|page) is (?:down|offline|under|closed) (?:for )?maintenance.*|wartungsarbeiten bis .*|maintenance en cours jusqu'à .*|mantenimiento en curso hasta .*",
    r"the database connection was refused|la base de datos rechazó la conexión|die datenbank (?:hat die verbindung abgelehnt|verweigerte? die verbindung|lehnte die verbindung ab)|la base de données a refusé la connexion",
    r"(?:your|the) session (?:has )?(?:ended|expired|timed out).*|ihre sitzung ist (?:abgelaufen|beendet).*|votre session (?:a expiré|est terminée|a pris fin).*|su sesión (?:ha caducado|ha terminado|ha expirado|caducó|terminó|expiró).*",
    r"(?:please )?log in again(?: to continue)?|(?:bitte )?melden sie sich (?:bitte )?erneut an|(?:veuillez vous reconnecter|reconnectez-vous)|(?:vuelva a iniciar sesión|inicie sesión de nuevo)",
    r"the (?:server )?response was empty|die antwort (?:des servers )?war leer|la réponse (?:du serveur )?était vide|la respuesta (?:del servidor )?(?:estaba vacía|llegó vacía|está vacía)",
    r"an exception was (?:thrown|raised) while .*|an unexpected (?:problem|error) occurred.*|the team has been (?:told|notified)",
    r"(?:the )?(?:upstream(?: (?:service|server))?|proxy|backend) (?:sent no reply|could not|did not|timed out|returned).*|der (?:vorgelagerte|nachgelagerte) dienst .* nicht.*|le service (?:amont|en amont) n'a .*|el servicio (?:ascendente|de origen) no .*",
    r"too many requests(?: came)?(?: from your address|:.*)?|zu viele anfragen von ihrer adresse|trop de requêtes (?:depuis|de) votre adresse|demasiadas peticiones desde su dirección|slow down",
    r"your account (?:lacks|does not have|has no) .*|you do not have (?:permission|the rights?|access) to .*|ihr konto darf diese ansicht nicht öffnen|sie haben keine berechtigung .*|votre compte ne permet pas .*|vous n'avez pas (?:le droit|l'autorisation) .*|su cuenta no permite .*|no tiene (?:permiso|autorización|acceso) para .*",
    r"the (?:entry|page|record)(?: you (?:asked for|requested))? (?:is no longer|no longer exists|does not exist|was not found).*|der (?:gesuchte |angeforderte )?eintrag (?:existiert|steht|ist) .*nicht mehr.*|l'entrée (?:demandée )?n'existe plus à cette adresse.*|la entrada (?:solicitada )?ya no existe en esta dirección.*",
    r"the address was moved without a redirect|die adresse wurde ohne weiterleitung verschoben|l'adresse a (?:été déplacée|changé) sans redirection|la dirección (?:cambió|se movió|se trasladó|fue movida) sin redirección|the accession in the link does not resolve",
    r"die anfrage konnte nicht bearbeitet werden|la requête n'a pas pu être traitée|no se pudo (?:procesar|tramitar|atender) la (?:solicitud|petición).*|la (?:solicitud|petición) no (?:se pudo|pudo) (?:ser )?(?:procesar|procesada|tramitar|atender).*|the request could not be (?:processed|handled|completed)",
    r"der dienst ist (?:zurzeit|derzeit|momentan|vorübergehend) nicht (?:erreichbar|verfügbar)|(?:le )?service (?:est )?(?:momentanément|temporairement) indisponible|el servicio no está disponible(?: por el momento)?",
    r"(?:an? )?(?:fatal|uncaught|unhandled)(?: \w+)?(?: error| exception)?:? .*(?: in <addr>| on line 0|exception|timed out).*|traceback \(most recent call last\):?.*|(?:\w+\.)*\w+(?:error|exception): .*|file \"[^\"]+\", line 0.*|segmentation fault.*|panic: .*|at [\w.$]+\([\w.]+(?:\.java:0|\.js:0|\.py:0|\.ts:0|\.cs:0|\.kt:0|\.scala:0|\.php:0)\)",
    r"\{ ?\"(?:code|status|error|message|detail)\" ?: ?.*\"(?:error|message|detail|trace)\" ?: ?.*\}?",
    r"(?:<code> )?forbidden forbidden|(?:<code> )?not found not found|resource unavailable",
)
#: Notices that scripts, cookies or a browser check are needed; a whole message.
NOTICES = (
    r"(?:please )?(?:enable|activate|turn on|allow|switch on) (?:javascript|scripts?|scripting|cookies)(?: and (?:cookies|javascript|scripts))?(?: .*)?",
    r"(?:this|our|the) (?:page|site|app|application|atlas|entry browser|structure viewer|viewer|view|portal|tool|database|browser|service|website)[\w ]{0,20} (?:needs?|requires?|cannot run without|can't run without|does not (?:work|run) without|works? only with|could not start because|will not (?:work|load|run) without) .{0,40}\b(?:javascript|scripts?|scripting|cookies)\b[\w ]*",
    r"you (?:need|have) to enable (?:javascript|scripts?|cookies).*|(?:cookies|scripts|javascript)(?: and (?:cookies|scripts|javascript))? must be (?:allowed|enabled|switched on).*|javascript is (?:disabled|switched off|required|not enabled).*",
    r"your browser is (?:not supported|out of date|outdated|too old).*|(?:please )?(?:use|update to|install) a newer browser.*|update it and allow scripts|allow scripts in the settings|turn it on and reload(?: the page)?",
    r"(?:please )?(?:confirm|verify|prove|show) that you are (?:not a robot|human).*|tick the box to show that you are human|(?:we are )?checking your browser.*|this may take a few seconds|if nothing happens, active scripting is switched off|(?:please )?complete the captcha.*",
    r"(?:diese seite|diese anwendung|diese website|der atlas|die strukturansicht|der betrachter|die datenbank|der eintragsbrowser|der viewer|[\p{L} ]{3,30}) (?:benötigt|verlangt|braucht|erfordert) (?:javascript|skripte|cookies)\b.*|[\p{L} ]{3,30} (?:funktioniert|läuft|startet) (?:nicht ohne|nur mit|ohne) (?:javascript|skripten?|cookies)(?: nicht)?|bitte (?:aktivieren|erlauben|schalten) sie (?:javascript|skripte|cookies|es ein).*|erlauben sie skripte in den einstellungen|ihr browser (?:wird geprüft|wird nicht unterstützt|hat sie abgeschaltet).*|bitte warten sie einen moment und lassen sie cookies zu|bestätigen sie, dass sie kein roboter sind.*",
    r"(?:cette page|cette application|ce site|l'atlas|la vue de la structure|[\p{L}' ]{3,30}) (?:exige|nécessite|requiert|a besoin de|demande) (?:javascript|de? scripts?|des scripts|scripts|les cookies)\b.*|[\p{L}' ]{3,30} ne fonctionne pas sans (?:scripts?|javascript|cookies)|(?:veuillez |merci d')?(?:activer|activez|autoriser|autorisez) (?:javascript|les scripts|les cookies|l?e? ?scripts?).*|activez-le puis rechargez.*|vérification d[eu] (?:votre )?navigateur.*|votre navigateur (?:n'est pas|les bloque).*|confirmez que vous n'êtes pas un robot.*",
    r"(?:esta página|esta aplicación|este sitio|el atlas|el visor de estructuras|[\p{L} ]{3,30}) (?:exige|necesita|requiere) (?:javascript|scripts?|cookies)\b.*|[\p{L} ]{3,30} no funciona sin (?:scripts?|javascript|cookies)|(?:active|habilite|permita|activar|por favor active) (?:javascript|los scripts|las cookies|scripts).*|actívelo y vuelva a cargar.*|(?:comprobando|verificando) (?:el|su) navegador.*|su navegador (?:no es compatible|los bloquea).*|confirme que no es un robot.*",
)
#: Messages about such notices and errors: contrasts, counts, reports.
ABOUT_NOTICES = r"(?iu)\b(?:whereas|unlike|contrairement|tandis que|im gegensatz|während|anders als|a diferencia|mientras que|were (?:dropped|counted|checked)|was lost|wurden|en cambio la tabla|in this note|nicht die tabelle)\b|; (?:la|die|le) tabl\w+ |tabelle darunter"

#: Words of trouble; a short message with one of them is residue only where it recurs widely and says nothing about it.
TROUBLE = r"javascript|cookies?|captcha|robots?|browser|navegador|navigateur|error|erreur|fehler|failed|fehlgeschlagen|échoué|falló|unavailable|nicht verfügbar|indisponible|no disponible|denied|verweigert|refusé|denegado|expired|abgelaufen|expiré|caducado|timed out|log ?in|anmelden|maintenance|wartung|mantenimiento|reload|rechargez|recargue|neu laden"
#: Words of reports, which tell that something happened to the project's own work.
REPORT = r"0 \p{L}{3,} (?!ago)[\p{L}, ]+|we|our|wir|unsere?r?|nous|notre|nos|nuestr[oa]s?|counted|gezählt|compt\w+|contad[oa]s?|\w+amos|rate|rates|model|modell|modèle|modelo|bars?|median|mittler\w+|measured|parser|table|tabelle|tableau|tabla"

_MASKS = tuple(
    (re.compile(pattern), name)
    for pattern, name in (
        (r"(?i)\b(?:https?|ftp)://[^\s<>\"]+|\bwww\.[^\s<>\"]+|[\w.+-]+@[\w-]+\.[\w.]+|(?<![\w<])/(?:[\w.-]+/)+[\w.-]+|\b\d{1,3}(?:\.\d{1,3}){3}\b", "<addr>"),
        (r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b", "<date>"),
        (r"(?<![^\W_]|[.{\[])[45]\d\d(?![^\W_]|%|[.,]\d)", "<code>"),
        (r"(?<![{0])\d+(?:[.,:]\d+)*", "0"),
    )
)
_BULLET = r"^(?:[-*•>#|]+ |\((?:Revised|Révisé|Revisado|Überarbeitet)\) |\p{Lu}\p{L}+ ?: (?=\p{Lu}|tb[dac]$|x{3}|n/a|\?\?|\.\.\.|> ))+"
_END = re.compile(r"[\s.!?…:;,–—-]+$")
_TAG = re.compile(r"(?i)</?(?:html|head|title|body|h[1-6]|p|hr|br|div|span|noscript|script|style|center|meta|link|a|b|i|em|strong|u|ul|ol|li|table|t[rdh]|pre|code|img)(?: [\w-]+=(?:\"[^\"]*\"|'[^']*'|\w+))*\s*/?>")
#: Lines of signs and empty words, at least two in a row, and list items that have only a label.
_RULES = r"(?:[-.?*_=]{3,}|tb[dac]|n/a(?: n/a)*|x{3,}(?: x{3,})*)"
_EMPTY_LINES = re.compile(rf"(?im)^[ \t]*(?:[-*•>] )?{_RULES}[ \t]*(?:\r?\n[ \t]*{_RULES}[ \t]*)+$")
_EMPTY_ITEMS = re.compile(r"(?im)^[ \t]*(?:item|element|élément|elemento|abschnitt|sección) \d+[ \t]*\r?\n[ \t]*(?:caption|description|title|heading|label|image|text|beschreibung|titel|légende|titre|descripción|título|leyenda)[ \t]*$")
_UNSEEN, _BLANKS = re.compile("[﻿​­]"), re.compile(r"[^\S\r\n]+")
_SPLIT = re.compile(r"(?<=[.!?…])\s+(?!\d)|\s*[\r\n]+\s*|\s+[—|]\s+")
_BARE_CODE = re.compile(r"[(\s]*[45]\d\d[\s.:!?…)]*$")
#: Weak signs: what pages offer beside an error; residue only where it recurs.
ASIDES = (
    r"(?:please )?try again (?:in 0 (?:minutes?|seconds?|hours?)|later)|versuchen sie es (?:in 0 minuten|später) erneut|réessayez (?:dans 0 minutes|plus tard)|inténtelo de nuevo (?:en 0 minutos|más tarde)",
    r"(?:reload the page|go back to the start page)(?: or .*)?|contact the help desk and quote .*|retry|zurück zur startseite|retour à l'accueil|volver al inicio|loading",
)
#: A message recurs in this many documents and more, and widely in this share of all documents too, in ``SOURCES`` sources.
RECURRING, WIDE_SHARE, SOURCES = 3, 5e-5, 2
#: Signs that may be put together from the alternatives of a pattern.
MOST_SIGNS = 200
#: Words of a message that recurrence may convict.
SHORT = 12


def _any(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


#: What may follow a message without a stop: a reference, an aside, or signs of other scripts.
_AFTER = r"(?:reference|ref|request|build|vorgang|référence|referencia|try again|retry|contact|please|reload|go back|home|zurück|volver|retour|versuchen|réessayez|inténtelo)\b.*"
_TAIL = rf"(?: (?:\(?0\b.*|{_AFTER})| [^a-zà-ÿ]+)?"
#: A status code without a reason, which residue has for a heading; other numbers look the same.
_BARE = rf"<code>(?: {_AFTER})?"
_BARE_SIGN = re.compile(rf"(?im)^[(\s]*[45]\d\d[\s.:!?…)]*(?:$|{_AFTER})")


@cache
def _rules() -> dict:
    import regex

    make = lambda p: regex.compile(rf"(?V0)(?:{p})", regex.IGNORECASE)
    fields = [regex.compile(p) for p in FIELDS]
    return {
        "fields": fields, "about_fields": regex.compile(ABOUT_FIELDS), "about": regex.compile(ABOUT_NOTICES), "bullet": regex.compile(_BULLET), "quoted": re.compile(r"[\"“„][^\"“”]{4,}[\"”“]"),
        "whole": make(rf"^(?:(?:{_any(FILLER + ERRORS + NOTICES)}){_TAIL}|{_BARE})$"), "part": make(rf"^(?:{_any(ERRORS + NOTICES)}){_TAIL}$"), "aside": make(rf"^(?:{_any(ASIDES)})$"),
        "trouble": make(rf"\b(?:{TROUBLE})\b"), "report": make(rf"\b(?:{REPORT})\b"), "keys": re.compile(rf"(?i)\b(?:(?:{'|'.join(KEYS.split())})(?:[,.;]? )){{3}}(?:{'|'.join(KEYS.split())})\b"), "heads": re.compile(r" ?[:;!] | [–—-] "),
    }


def signs(pattern: str) -> set[str] | None:
    """Strings (lower case) of which every match of a pattern holds one, as long as can be; none where that can't be told.

    Digits and the names of masks don't stand in the text itself, so strings are cut there.
    """
    from re import _parser

    plain = re.sub(r"^\(\?\w+\)", "", pattern).replace(r"\p{Lu}", r"\w").replace(r"\p{Ll}", r"\w").replace(r"\p{L}", r"\w")

    def best(sets: list[set[str] | None]) -> set[str] | None:
        known = [s for s in sets if s]
        return max(known, key=lambda s: (min(min(len(x.strip()) for x in s), 8), -len(s))) if known else None

    def plainly(op: object, value: object) -> set[str] | None:
        """All strings of an item, if they are few."""
        name = str(op)
        if name == "LITERAL":
            return {chr(value)}
        if name == "IN" and len(value) <= 4 and all(str(o) == "LITERAL" for o, _ in value):
            return {chr(v) for _, v in value}
        if name == "SUBPATTERN":
            return joined(value[3])
        if name == "BRANCH":
            parts = [joined(v) for v in value[1]]
            return set().union(*parts) if all(parts) else None
        if name == "MAX_REPEAT" and value[1] <= 1:
            part = joined(value[2])
            return part | {""} if part else None
        return None

    def joined(items: list) -> set[str] | None:
        out = {""}
        for op, value in items:
            part = plainly(op, value)
            if part is None or len(out) * len(part) > MOST_SIGNS:
                return None
            out = {a + b for a in out for b in part}
        return out

    def own(run: set[str]) -> set[str] | None:
        parts = {max(re.split(r"<(?:addr|date|code)>|\d+", t), key=len).lower() for t in run}
        return parts if all(t.strip() for t in parts) else None

    def read(items: list) -> set[str] | None:
        found, run = [], {""}
        for op, value in items:
            name = str(op)
            part = plainly(op, value)
            if part is not None and len(run) * len(part) <= MOST_SIGNS:
                run = {a + b for a in run for b in part}
                continue
            found.append(own(run))
            run = part if part is not None else {""}
            if name == "SUBPATTERN":
                found.append(read(value[3]))
            elif name == "BRANCH":
                parts = [read(v) for v in value[1]]
                found.append(set().union(*parts) if all(parts) else None)
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                several = joined(value[2])
                if several is not None and len(several) == 1:
                    found.append(own({next(iter(several)) * value[0]}))
                else:
                    found.append(read(value[2]))
        return best([*found, own(run)])

    return read(list(_parser.parse(plain)))


@cache
def _automaton() -> object:
    import ahocorasick

    a = ahocorasick.Automaton()
    known: set[str] = set()
    for pattern in (*FIELDS, *FILLER, *ERRORS, *NOTICES, *ASIDES, TROUBLE):
        own = signs(pattern)
        if not own:
            raise ValueError(f"no sign in {pattern}")
        known |= own
    known |= {w for w in LATIN.split() if len(w) > 4} | {a + between + b for a in KEYS.split() for b in KEYS.split() for between in (" ", ", ", ". ", "; ")}
    for k in known:
        a.add_word(k, k)
    a.make_automaton()
    return a


def _held(text: str) -> bool:
    return next(_automaton().iter(text.lower()), None) is not None


def cleaned(text: str) -> str:
    """A text without unseen signs and tags, with single blanks and a word for lines and items that are empty."""
    t = _BLANKS.sub(" ", _UNSEEN.sub("", text))
    t = _TAG.sub("\n", t) if "<" in t else t
    return _EMPTY_ITEMS.sub("placeholder text", _EMPTY_LINES.sub("xxxx", t))


def messages(text: str) -> list[str]:
    """The distinct masked lines and sentences of a text that hold a sign. A status code alone stays only where it opens the text."""
    t = cleaned(text)
    if not _held(t) and not _BARE_SIGN.search(t):
        return []
    bullet, out, first = _rules()["bullet"], {}, True
    for part in _SPLIT.split(t):
        said = bullet.sub("", " ".join(part.split())).strip()
        if len(said) < 2:
            continue
        if (first or not _BARE_CODE.match(said)) and (_held(said) or _BARE_SIGN.match(said)):
            out[masked(said)] = None
        first = False
    return list(out)


def masked(message: str) -> str:
    for pattern, name in _MASKS:
        message = pattern.sub(name, message)
    return message


@cache
def _words() -> tuple[set, set]:
    return set(LATIN.split()), set(JOINTS.split())


def filler(message: str) -> bool:
    """Five words of the usual filler in a row, one of them long, or four of the keyboard; or five words and more, two of them of the filler and one of these long, without a word that joins sentences."""
    latin, joints = _words()
    if _rules()["keys"].search(message):
        return True
    words = re.findall(r"[^\W\d_]+", message.lower())
    run: list[str] = []
    for w in words:
        run = [*run, w] if w in latin else []
        if len(run) >= 5 and max(map(len, run)) > 4:
            return True
    held = {w for w in words if w in latin and w not in joints}
    return len(words) >= 5 and len(held) > 1 and max(map(len, held)) > 4 and not any(w in joints for w in words)


def judged(message: str, documents: int, sources: int, total: int) -> bool:
    """Whether a masked message is residue; it occurs in ``documents`` of ``total`` documents, of ``sources`` sources."""
    r = _rules()
    if any(f.search(message) for f in r["fields"]) and not r["about_fields"].search(message) or filler(message):
        return True
    unquoted = r["quoted"].sub('""', message)
    about = r["about"].search(message) is not None
    inner = _END.sub("", message if message.startswith(('{"', '{ "', 'File "')) else unquoted)
    if not about and r["whole"].match(inner):
        return True
    if not about and '""' not in unquoted:
        for head in r["heads"].split(inner):
            head = _END.sub("", head)
            if len(head) > 3 and r["part"].match(head):
                return True
    if documents < RECURRING:
        return False
    if r["aside"].match(inner):
        return True
    wide = documents >= WIDE_SHARE * total and sources >= SOURCES
    return wide and not about and '""' not in unquoted and len(inner.split()) <= SHORT and r["trouble"].search(inner) is not None and r["report"].search(inner) is None


def residue_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str | None = "source") -> DataFrame:
    """The ids of documents that hold residue in place of content, each once.

    Null, empty and blank texts are no cases; a null id takes no part; whole texts are read, however long. Repeated rows count
    once. Empty tables give no rows; columns other than the three named aren't read. Without a ``source`` column (or where
    none is named) all documents are of one source, and no message recurs widely. The threshold of wide recurrence is a share
    of the number of documents.
    """
    src = F.col(source).cast("string") if source and source in documents.columns else F.lit(None).cast("string")
    docs = documents.select(F.col(doc_id).alias("d"), src.alias("source"), F.col(text).cast("string").alias("t")).where("d is not null and t is not null")
    kind = dict(docs.dtypes)["d"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, said = [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                own = messages(t)
                said += own
                rows += [i] * len(own)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(said, pa.string())], names=["d", "source", "m"])

    keyed = settle(docs.mapInArrow(read, f"d {kind}, source string, m string").distinct().withColumn("h", F.xxhash64("m")), "messages")
    total = documents.where(F.col(doc_id).isNotNull()).count()
    groups = keyed.groupBy("h", "m").agg(F.count_distinct("d").alias("documents"), F.count_distinct("source").alias("sources"))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = pa.array([judged(m, n, k, total) for m, n, k in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(stay), batch.column(1).filter(stay)], names=["h", "m"])

    found = groups.mapInArrow(classify, "h bigint, m string")
    return keyed.join(found, ["h", "m"], "left_semi").select(F.col("d").alias(doc_id)).distinct()
