"""Public wording of servers, site software and templates, collected before the rules for it were written, and articles that mention such wording."""

NOTICES = [
    # English: servers and gateways
    "HTTP Error 503. The service is unavailable.", "404 Not Found\nnginx/1.18.0 (Ubuntu)", "Not Found\nThe requested URL /old/index.html was not found on this server.\nApache/2.4.41 Server at example.org Port 443",
    "Forbidden\nYou don't have permission to access this resource.", "502 Bad Gateway\nThe server returned an invalid or incomplete response.", "504 Gateway Time-out\nThe server didn't respond in time.",
    "Service Unavailable\nThe server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.",
    "Internal Server Error\nThe server encountered an internal error or misconfiguration and was unable to complete your request.\nPlease contact the server administrator and inform them of the time the error occurred.",
    "HTTP Status 404 - Not Found\nThe origin server did not find a current representation for the target resource or is not willing to disclose that one exists.",
    "Error 1020\nAccess denied\nThis website is using a security service to protect itself from online attacks.", "Error establishing a database connection", "There has been a critical error on this website.",
    "Briefly unavailable for scheduled maintenance. Check back in a minute.", "This site can't be reached. The connection was reset.", "Whoops, looks like something went wrong.", "429 Too Many Requests\nYou have been rate limited. Slow down and retry after 60 seconds.",
    "Bandwidth Limit Exceeded\nThe server is temporarily unable to service your request due to the site owner reaching the bandwidth limit.", "This account has been suspended. Contact your hosting provider for more information.",
    "Sorry, this content isn't available right now. The owner may have shared it with a small group of people or deleted it.", "Oops! That page can't be found. It looks like nothing was found at this location. Maybe try a search?",
    "The article you are looking for may have been removed, had its name changed, or is temporarily unavailable.", "This video is no longer available because the account associated with it has been terminated.",
    # English: scripts and checks
    "For full functionality of this site it is necessary to enable JavaScript.", "You need to enable JavaScript to run this app.", "We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.",
    "JavaScript is disabled in your browser. Please enable it and reload the page.", "Please turn JavaScript on and reload the page.", "Just a moment...\nEnable JavaScript and cookies to continue", "Please verify you are a human\nComplete the security check to access the site.",
    "Your browser is out of date or JavaScript has been blocked by an extension. This page cannot be displayed.",
    # English: filler
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.",
    "At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident.",
    "Insert your text here. This is a placeholder paragraph that you can replace with your own content.", "This is an example page. It's different from a blog post because it will stay in one place.", "Add your heading text here\nClick edit button to change this text.", "asdf asdf asdf asdf asdf asdf asdf asdf",
    # German
    "Fehler 404: Die von Ihnen gesuchte Seite konnte leider nicht gefunden werden.", "Die Website ist wegen Wartungsarbeiten vorübergehend nicht erreichbar. Bitte versuchen Sie es später noch einmal.", "Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite nutzen zu können.",
    "Sie haben keine Berechtigung, auf diese Seite zuzugreifen.", "Ein unerwarteter Fehler ist aufgetreten. Bitte wenden Sie sich an den Administrator.", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.", "Diese Seite existiert nicht mehr oder wurde verschoben.",
    "Der Server ist zurzeit überlastet und kann Ihre Anfrage nicht bearbeiten.",
    # French
    "La page que vous recherchez est introuvable ou a été déplacée.", "Erreur interne du serveur. Veuillez réessayer plus tard.", "JavaScript est désactivé dans votre navigateur. Veuillez l'activer pour continuer.", "Vous n'êtes pas autorisé à accéder à cette page.",
    "Le site est actuellement en maintenance. Merci de revenir plus tard.", "Une erreur est survenue lors du traitement de votre demande.", "Votre session a expiré, veuillez vous reconnecter.", "Ce contenu n'est plus disponible.",
    # Spanish
    "La página que busca no se ha encontrado o ya no está disponible.", "Error interno del servidor. Por favor, inténtelo de nuevo más tarde.", "Para ver esta página necesita activar JavaScript en su navegador.", "No tiene autorización para acceder a esta página.",
    "El sitio está en mantenimiento. Vuelva a intentarlo más tarde.", "Ha ocurrido un error inesperado. Póngase en contacto con el administrador.", "Su sesión ha caducado. Inicie sesión de nuevo.", "El servicio no está disponible en este momento.",
]

_EN = "The museum of clocks opened its new wing on Saturday. Visitors walked past forty tower clocks, and the oldest of them, made by a smith in 1640, still strikes every hour. Entry costs three coins on weekdays."
_DE = "Das Uhrenmuseum hat am Samstag einen neuen Flügel geöffnet. Die Besucher gingen an vierzig Turmuhren vorbei, und die älteste, die ein Schmied im Jahr 1640 baute, schlägt noch jede Stunde."
_FR = "Le musée des horloges a ouvert samedi une nouvelle aile. Les visiteurs ont longé quarante horloges de clocher, et la plus vieille, faite par un forgeron en 1640, sonne encore chaque heure."
_ES = "El museo de relojes abrió el sábado un ala nueva. Los visitantes pasaron junto a cuarenta relojes de torre, y el más viejo, hecho por un herrero en 1640, todavía da cada hora."

_MENTION = {
    _EN: [
        "Online tickets were sold out, and for an hour the shop answered with 503 Service Unavailable.", "The guide jokes that a stopped clock is the 404 Not Found of the tower.", "Anyone without JavaScript could not book, so the director printed forms on paper.", "The mayor said the old server had failed twice in May.",
        "Please enable JavaScript to watch the film of the opening.", "Access denied, read the sign on the door of the workshop, and nobody minded.", "In the first version of the site every room was described in lorem ipsum.", "The page about the sundial has been removed because its owner asked for it.",
        "Our session ended with tea, and we logged out of the archive at five.", "A placeholder card lies where the lost watch will go.", "Something went wrong with the bell in 1702, and the town burned for a day.", "The error of the oldest clock is two minutes a week.",
        "You do not have permission to touch the wheels, but the curator lets children wind one.", "Too many requests for tours reached the office, so it took on two students.", "The workshop is under construction until autumn.", "The template of the invitation still said {{first_name}} on forty cards, which made people laugh.",
        "Come back soon, says the last panel, in six languages.", "This content is not available in Latin, a panel says of the audio tour.", "A critical error in the catalogue gave one clock two makers.", "Checking your browser takes nine seconds, a visitor complained about the booking page.",
    ],
    _DE: [
        "Die Kasse im Netz meldete eine Stunde lang einen Serverfehler.", "Wer die alte Adresse aufrief, las „Seite nicht gefunden“ und rief im Büro an.", "Ohne JavaScript ließ sich keine Karte kaufen.", "Der Zugriff auf das Archiv ist bis zum Herbst gesperrt.", "Die Werkstatt ist wegen Wartung geschlossen, die Uhren gehen trotzdem.",
        "Ein Platzhalter liegt dort, wo die verlorene Uhr liegen soll.", "Der Fehler der ältesten Uhr beträgt zwei Minuten in der Woche.", "Die Sitzung des Rates ist nach zwei Stunden beendet worden.", "Bitte aktivieren Sie JavaScript, um den Film zu sehen.", "Im ersten Entwurf stand überall Blindtext, und ein Raum hieß noch Mustertitel.",
        "Die Seite über die Sonnenuhr wurde entfernt, weil der Besitzer darum bat.", "Keine Berechtigung hatte der Lehrling, das große Rad zu drehen.", "Versuchen Sie es später noch einmal, riet der Wärter einem Kind, das den Kuckuck sehen wollte.", "Der Dienst am Turm war hart, und der Server im Keller ist es auch.",
    ],
    _FR: [
        "La billetterie a affiché pendant une heure une erreur du serveur.", "Qui suivait l’ancien lien lisait « page introuvable » et téléphonait au bureau.", "Sans JavaScript, personne ne pouvait réserver.", "L’accès à l’atelier est interdit aux enfants, sauf le dimanche.", "L’erreur de la plus vieille horloge est de deux minutes par semaine.",
        "Veuillez activer JavaScript pour voir le film.", "La page du cadran solaire a été supprimée à la demande de son maître.", "La session du conseil est terminée depuis midi.", "Un faux texte remplissait encore trois panneaux le jour de l’ouverture.", "Le site est en maintenance le lundi, comme la grande roue.",
        "Réessayez plus tard, dit le gardien à ceux qui viennent trop tôt.", "Ce contenu n’est plus disponible en latin, précise un panneau.", "Vous n’avez pas le droit de toucher les roues, dit une affiche.",
    ],
    _ES: [
        "La taquilla mostró durante una hora un error del servidor.", "Quien seguía el enlace viejo leía « página no encontrada » y llamaba a la oficina.", "Sin JavaScript nadie podía reservar.", "El acceso al taller está prohibido a los niños, salvo los domingos.", "El error del reloj más viejo es de dos minutos por semana.",
        "Active JavaScript para ver la película.", "La página del reloj de sol fue eliminada porque lo pidió su dueño.", "La sesión del consejo ha terminado a mediodía.", "Un texto de relleno llenaba todavía tres paneles el día de la apertura.", "El sitio está en mantenimiento los lunes, igual que la rueda grande.",
        "Inténtelo más tarde, dice el guarda a los que llegan pronto.", "Este contenido no está disponible en latín, aclara un panel.", "No tiene permiso para tocar las ruedas, dice un cartel.",
    ],
}

#: Articles with the wording behind, before and inside.
ARTICLES = [text for a, ms in _MENTION.items() for k, m in enumerate(ms) for text in [(f"{a} {m}", f"{m}\n{a}", a.replace(". ", f". {m} ", 1))[k % 3]]]
