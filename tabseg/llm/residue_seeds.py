"""Example texts from which the residue models are fitted, built from short lists of forms and words."""

from __future__ import annotations

import random

#: What notebook templates ask for, by language.
FIELDS = {
    "en": ("your name", "title", "author", "date", "dataset", "description", "conclusion", "summary", "course code", "project name", "goal of this notebook", "reviewer"),
    "de": ("Titel", "Name", "Datum", "Datensatz", "Beschreibung", "Zusammenfassung", "Autor", "Fazit", "Kurs", "Projektname", "Ziel"),
    "fr": ("titre", "votre nom", "nom", "date", "jeu de données", "description", "conclusion", "résumé", "auteur", "projet", "objectif"),
    "es": ("título", "su nombre", "nombre", "fecha", "conjunto de datos", "descripción", "resumen", "conclusión", "autor", "proyecto", "objetivo"),
}
#: Notations of unfilled fields; {x} the field, {u} as an identifier, {U} in capitals.
NOTATIONS = (
    "{{{{ {u} }}}}", "{{{{{u}}}}}", "{{{{cfg.{u}}}}}", "{{{{page.{u}}}}}", "{{{{nb.{u}}}}}", "{{% block {u} %}}{{% endblock %}}", "<%= {u} %>", "${{{U}}}", "${{{u}}}", "#{{{u}}}", "$({u})",
    "__{U}__", "%%{U}%%", "@@{u}@@", "XX-{C}-XX", "<<{x}>>", "[[{x}]]", "<{x}>",
)
#: Prompts to the author, by language; {x} the field, {C} in capitals.
PROMPTS = {
    "en": ("[Insert {x} here]", "({x} goes here)", "YOUR {C} HERE", "Replace this text with the {x}.", "TBD - {x}", "TODO: write the {x}", "TODO: add the {x}", "Click to add {x}", "<your {x}>", "Add your {x} here", "Enter the {x} here"),
    "de": ("HIER {C} EINSETZEN", "<{x} eintragen>", "Bitte {x} ergänzen", "[{x} hier einfügen]", "TODO: {x} schreiben", "{x} folgt"),
    "fr": ("À compléter : {x}", "[insérer {x} ici]", "<votre {x}>", "Remplacer ce texte par {x}.", "ICI {C}", "Ajouter {x} ici"),
    "es": ("Pendiente: completar {x}", "[inserte {x} aquí]", "<su {x}>", "AQUÍ {C}", "Reemplace este texto por {x}.", "Escriba aquí {x}"),
}
#: Words of filler text, and words and marks that are repeated in place of text.
LATIN = "lorem ipsum dolor sit amet elit sed tempor labore dolore magna aliqua enim minim veniam quis nulla culpa mollit sint irure velit fugiat cillum laborum".split()
REPEATED = ("xxx", "text", "test", "foo bar", "sample text", "bla", "blah", "texto", "texte", "dummy", "lorem", "placeholder", "asdf", "...", "filler", "content", "Beispieltext", "contenu")
#: How filler is announced, by language: {a} what it is, {b} what it is called, {c} what becomes of it.
FILLER = {
    "en": ("{a} {b}.", "This is {a} {b}.", "Some {a} {b} here.", "{a} {b}, {c}.", "{a} {b} {c}.", "This is {a} {b} and {c}.", "More {b} here. Even more {b} here.", "Some {b} about the topic."),
    "de": ("{a}{b}.", "Hier steht {a}{b}.", "Das ist ein {a}{b}.", "{a}{b}, {c}.", "Hier {c}.", "Hier steht {c} ein {b}."),
    "fr": ("{b} de {a}.", "{b} de {a}, {c}.", "Ceci est un {b} de {a}.", "{b} de {a} {c}."),
    "es": ("{b} de {a}.", "{b} de {a}, {c}.", "Este es un {b} de {a}.", "{b} de {a} {c}."),
}
FILLER_WORDS = {
    "en": ("placeholder|dummy|sample|filler|example".split("|"), "text|paragraph|copy|content|sentence".split("|"), "to be replaced|will be replaced later|real text to follow|the real one comes later|to follow|will go here".split("|")),
    "de": ("Platzhalter|Blind|Füll|Beispiel|Muster".split("|"), "text|absatz|inhalt".split("|"), "wird später ersetzt|folgt noch|kommt noch|später|wird noch ersetzt".split("|")),
    "fr": ("remplissage|démonstration|substitution".split("|"), "Texte|Paragraphe|Contenu".split("|"), "à remplacer|sera remplacé plus tard|à venir".split("|")),
    "es": ("relleno|ejemplo|prueba".split("|"), "Texto|Párrafo|Contenido".split("|"), "por reemplazar|se cambiará más tarde|pendiente|se reemplazará después".split("|")),
}
#: What bare list entries are called.
ITEMS = ("item", "list item", "point", "bullet", "bullet point", "bullet text", "entry", "Punkt", "Eintrag", "Listenpunkt", "punto", "elemento", "élément", "entrée", "liste")
ROWS = ("asdfghjkl", "qwertyuiop", "zxcvbnm")
#: The reason phrases of HTTP status codes, and other general words of error pages and notices that scripts are needed, by language.
REASONS = (
    "Bad request|Unauthorized|Payment required|Forbidden|Not found|Method not allowed|Not acceptable|Request timeout|Conflict|Gone|Length required|Payload too large|URI too long|Unsupported media type|Range not satisfiable|Locked|Too early|Upgrade required|"
    "Too many requests|Unavailable for legal reasons|Internal server error|Internal error|Not implemented|Bad gateway|Service unavailable|Service temporarily unavailable|Gateway timeout|Insufficient storage|Network authentication required|Access denied|Permission denied|Page not found|File not found|"
    "Connection timed out|Connection refused|Connection reset|Zugriff verweigert|Zugriff nicht erlaubt|Seite nicht gefunden|Datei nicht gefunden|Nicht gefunden|Interner Fehler|Interner Serverfehler|Dienst nicht verfügbar|Zeitüberschreitung|Accès refusé|Accès interdit|Page introuvable|Page non trouvée|"
    "Fichier introuvable|Erreur interne|Erreur interne du serveur|Service indisponible|Délai dépassé|Acceso denegado|Acceso prohibido|Página no encontrada|Archivo no encontrado|No encontrado|Error interno|Error interno del servidor|Servicio no disponible|Tiempo de espera agotado"
).split("|")
SUBJECTS = {
    "en": "page|file|document|notebook|resource|repository|preview|link|address|content|server|site|viewer|item|version|project".split("|"),
    "de": "Die Seite|Die Datei|Das Dokument|Das Notizbuch|Die Vorschau|Der Server|Der Inhalt|Die Adresse|Das Projekt|Diese Seite|Diese Datei|Dieses Notizbuch|Dieses Dokument".split("|"),
    "fr": "La page|Le fichier|Le document|Le carnet|L’aperçu|Le serveur|Le contenu|L’adresse|Le dépôt|Cette page|Ce fichier|Ce carnet|Ce document".split("|"),
    "es": "La página|El archivo|El documento|El cuaderno|La vista previa|El servidor|El contenido|La dirección|El recurso|Esta página|Este archivo|Este cuaderno|Este documento".split("|"),
}
FAILURES = {
    "en": (
        "could not be found|was not found|cannot be found|does not exist|no longer exists|is no longer available|is not available|is unavailable|is temporarily unavailable|could not be loaded|failed to load|could not be displayed|cannot be displayed|could not be opened|could not be rendered|"
        "did not respond|did not answer|did not answer in time|took too long to respond|sent no response|timed out|was deleted|was removed|has been removed|has been taken down|was moved|has been moved|is private|is restricted|is restricted to members|is not public|is offline|is down for maintenance|is offline for maintenance|"
        "is under maintenance|is too large|is too large to display|is too big to be shown|is empty or damaged|is blocked|does not exist or was moved|is private or was deleted|is not allowed|has expired"
    ).split("|"),
    "de": "wurde nicht gefunden|existiert nicht|existiert nicht mehr|ist nicht mehr verfügbar|ist nicht verfügbar|ist zurzeit nicht erreichbar|konnte nicht geladen werden|kann nicht angezeigt werden|konnte nicht geöffnet werden|antwortet nicht|hat nicht geantwortet|wurde gelöscht|wurde verschoben|wurde gelöscht oder verschoben|ist privat|ist zu groß|ist gesperrt|wird gewartet".split("|"),
    "fr": "est introuvable|n’existe pas|n’existe plus|n’est plus disponible|n’est pas disponible|est momentanément indisponible|n’a pas pu être chargé|ne peut pas être affiché|n’a pas pu être ouvert|ne répond pas|n’a pas répondu|a été supprimé|a été déplacé|a été supprimé ou déplacé|est privé|est trop volumineux|est bloqué|est en maintenance".split("|"),
    "es": "no se encuentra|no se encontró|no existe|ya no existe|ya no está disponible|no está disponible|no está disponible por ahora|no se pudo cargar|no se puede mostrar|no se pudo abrir|no responde|no respondió|fue eliminado|fue movido|fue eliminado o movido|es privado|es demasiado grande|está bloqueado|está en mantenimiento".split("|"),
}
READERS = {
    "en": "page|site|viewer|app|application|editor|reader|notebook".split("|"),
    "de": "Diese Seite|Diese Ansicht|Diese Anwendung|Der Betrachter|Der Editor".split("|"),
    "fr": "Cette page|Ce site|Cette application|La visionneuse|L’éditeur".split("|"),
    "es": "Esta página|Este sitio|Esta aplicación|El visor|El editor".split("|"),
}
NEEDS = {
    "en": "needs|requires|relies on|depends on|does not work without|cannot run without|will not load without".split("|"),
    "de": "benötigt|braucht|erfordert|funktioniert nicht ohne|läuft nicht ohne".split("|"),
    "fr": "nécessite|exige|a besoin de|ne fonctionne pas sans|ne marche pas sans".split("|"),
    "es": "necesita|requiere|no funciona sin|depende de".split("|"),
}
SCRIPTS = {
    "en": "scripts|JavaScript|scripts to run|scripts to work|JavaScript to run|JS and cookies|JavaScript and cookies|client-side scripting".split("|"),
    "de": "Skripte|JavaScript|aktive Skripte|aktiviertes JavaScript".split("|"),
    "fr": "JavaScript|les scripts|des scripts|scripts pour fonctionner|scripts".split("|"),
    "es": "JavaScript|scripts|los scripts|scripts para funcionar".split("|"),
}
#: Whole sentences as templates; {s} and {p} as above.
NOTICES = {
    "en": (
        "You need to enable {p}.", "You need to enable {p} to run this {s}.", "Please enable {p} to view this {s}.", "Please turn on {p} and reload.", "Turn on {p} and reload the {s}.", "Allow {p} and cookies for this {s} to continue.", "To continue, enable {p}.", "Your browser does not support {p}.",
        "Your browser blocks {p}.", "Your browser has {p} turned off, so the {s} cannot start.", "{p} is turned off in your browser.", "{p} are turned off in your browser.", "{p} is disabled.", "{p} is disabled in this browser.", "{p} are blocked.", "Enable {p}.", "Loading {s}... ({p} required)", "{p} required.",
        "You do not have permission to open this {s}.", "You do not have access to this {s}.", "You are not allowed to open this {s}.", "You must sign in to see this {s}.", "Please sign in to continue.", "Your session has ended. Please sign in again.", "Your login has expired. Please log in again.", "Try again later.", "Please try again later.",
        "Please try again in a few minutes.", "Slow down and try again.", "Too many attempts, please wait.", "Something went wrong.", "Something went wrong while loading the {s}.", "An error occurred.", "An unexpected error occurred on our side.", "We are sorry.", "If this keeps happening, contact support.", "Contact the administrator if the problem persists.",
        "Verify that you are not a robot.", "We need to verify that you are human.", "Reload the {s}.", "Reload", "Retry", "Go back", "Go to the home page", "Back to the start page", "Return to the main page", "Back to the {s}", "Error code 0", "Error 0", "HTTP error 0", "HTTP 0", "Status 0", "Request id 0a0b0c", "Reference 0a0b0c", "Incident 0a0b", "(ref 0a0b0c)",
    ),
    "de": (
        "Bitte schalten Sie {p} ein.", "Bitte aktivieren Sie {p} und laden Sie die Seite neu.", "{p} ist ausgeschaltet.", "{p} ist in diesem Browser ausgeschaltet.", "{p} ist deaktiviert.", "Ihr Browser blockiert {p}.", "Im Browser ist {p} deaktiviert.", "Sie haben keinen Zugriff auf diese Seite.", "Sie haben keine Berechtigung für diese Datei.",
        "Bitte melden Sie sich an.", "Bitte versuchen Sie es erneut.", "Bitte versuchen Sie es später wieder.", "Später erneut versuchen.", "Es ist ein Fehler aufgetreten.", "Ein unerwarteter Fehler ist aufgetreten.", "Neu laden", "Zurück", "Zurück zur Startseite", "Zur Startseite gehen", "Fehler 0", "Vorgang 0a0b", "Kennung 0a0b",
    ),
    "fr": (
        "Veuillez activer {p}.", "Activez {p} pour continuer.", "{p} est désactivé.", "{p} est désactivé dans votre navigateur.", "Votre navigateur bloque {p}.", "Vous n’avez pas accès à cette page.", "Vous n’avez pas l’autorisation de voir ce fichier.", "Veuillez vous connecter.", "Veuillez réessayer plus tard.", "Réessayez dans quelques minutes.",
        "Une erreur est survenue.", "Une erreur inattendue est survenue.", "Recharger", "Retour", "Retour à la page d’accueil", "Aller à l’accueil", "Erreur 0", "Référence 0a0b", "Incident 0a0b",
    ),
    "es": (
        "Active {p} para continuar.", "Por favor, active {p}.", "{p} está desactivado.", "{p} está desactivado en su navegador.", "Su navegador bloquea {p}.", "No tiene acceso a esta página.", "No tiene permiso para abrir este archivo.", "Inicie sesión para continuar.", "Inténtelo de nuevo más tarde.", "Vuelva a intentarlo más tarde.",
        "Se produjo un error.", "Ha ocurrido un error inesperado.", "Recargar", "Volver", "Volver a la página de inicio", "Ir al inicio", "Error 0", "Referencia 0a0b", "Incidente 0a0b",
    ),
}
#: Entries of the bars above and below pages.
MENU = "Home|Sign in|Sign up|Log in|Help|Docs|About|Contact|Pricing|Explore|Privacy|Terms|Status|Blog|Support|Download".split("|")


def placeholders() -> list[str]:
    out = []
    for language, fields in FIELDS.items():
        for x in fields:
            u = x.replace(" ", "_")
            names = {"x": x, "u": u, "U": u.upper(), "C": x.upper()}
            for form in (*NOTATIONS, *PROMPTS[language]):
                said = form.format(**names)
                out += [said, f"# {said}", f"## {said}", f"**{x.capitalize()}:** {said}"]
    return out


def bare_fields() -> list[str]:
    """Headings that name a field and nothing else."""
    return [form.format(x) for fields in FIELDS.values() for x in fields for form in ("{}", "# {}", "## {}", "### {}")]


def filler(seed: int = 9) -> list[str]:
    rng = random.Random(seed)
    out = [" ".join(rng.choice(LATIN) for _ in range(24)).capitalize() + "." for _ in range(400)]
    out += ["Lorem ipsum " + " ".join(rng.choice(LATIN) for _ in range(12)) + "." for _ in range(100)]
    out += [" ".join([w] * 24) for w in REPEATED for _ in range(4)] + [w[0] * 30 for w in REPEATED] + [f"{w.capitalize()}." * 4 for w in REPEATED] + [" ".join([f"{w.capitalize()}."] * 4) for w in REPEATED]
    for language, forms in FILLER.items():
        kinds, names, ends = FILLER_WORDS[language]
        for form in forms:
            said = [form.format(a=a, b=b, c=c) for a in kinds for b in names for c in (ends if "{c}" in form else ends[:1])]
            out += [x[0].upper() + x[1:] for x in said]
    return out + [f"{mark} {w} 0" for x in ITEMS for w in (x, x.capitalize()) for mark in ("-", "*", "-") for _ in range(3)]


def mash(seed: int = 9) -> list[str]:
    """Keys of one row of the keyboard, hit at random."""
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(row) for _ in range(rng.randint(3, 8))) for _ in range(12)) for row in (*ROWS[:1] * 8, *ROWS[1:]) for _ in range(60)]


def errors(seed: int = 9) -> list[str]:
    """General subjects with what may have befallen them, readers with the scripts that they need, notices, reason phrases and menus."""
    rng = random.Random(seed)
    out = []
    for language, failures in FAILURES.items():
        heads = [f"{d} {x}" for x in SUBJECTS["en"] for d in ("The", "This", "That", "Our")] if language == "en" else SUBJECTS[language]
        out += [f"{x} {f}." for x in heads for f in failures]
        readers = [f"{d} {x}" for x in READERS["en"] for d in ("The", "This", "Our")] if language == "en" else READERS[language]
        out += [f"{x} {n} {w}." for x in readers for n in NEEDS[language] for w in SCRIPTS[language]]
        names = SUBJECTS["en"] if language == "en" else [""]
        for form in NOTICES[language]:
            said = sorted({form.format(s=x, p=w) for x in names for w in SCRIPTS[language][:2]})
            out += (said * 24)[: max(24, len(said))]
    out += [f"{lead}{x}{tail}" for x in REASONS for lead in ("", "0 ", "Error 0: ", "The ") for tail in ("", ".")] * 4
    return out + [" | ".join(rng.sample(MENU, rng.randint(2, 6))) for _ in range(300)] + [f"(c) {x} 0" for x in ("Site", "Company", "Project", "Foundation")] * 6
