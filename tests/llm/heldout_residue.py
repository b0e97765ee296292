"""A held-out set for template residue, written before the phrase lists were collected and used for measuring only.

Everyday wording of error pages, notices that scripts are required, fillers and unfilled fields in
several languages, and ordinary texts, some of which write about such things.
"""

RESIDUE = [
    "You need to enable JavaScript to run this app.",
    "Oops! That page can't be found.",
    "We can't find the page you're looking for.",
    "Insert text here.",
    "Just a moment... Verifying you are human",
    "404 - File or directory not found.",
    "This page isn't working. If the problem continues, contact the site owner.",
    "HTTP Error 500. An internal server error occurred.",
    "Please turn JavaScript on and reload the page.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.",
    "Dear {{first_name}}, thank you for your order {{order_id}}.",
    "Hello ${customer.name}, your invoice is attached.",
    "[Insert company name here] was founded in [year].",
    "Dear %%FIRSTNAME%%, welcome!",
    "<%= user.name %> has joined.",
    "502 Bad Gateway\nnginx/1.18.0",
    "Access to this page has been denied.",
    "Sorry, you have been blocked. You are unable to access this site.",
    "Your session has timed out. Please log in again.",
    "The requested URL was not found on this server.",
    "Service Temporarily Unavailable",
    "Too many connections. Try again in a few minutes.",
    "Warning: mysqli_connect(): Connection refused in /var/www/index.php on line 12",
    "Add your description here",
    "Your text goes here.",
    "Coming soon!",
    "Under construction",
    "TODO: write introduction",
    "Diese Seite konnte nicht gefunden werden.",
    "Bitte aktivieren Sie JavaScript in Ihrem Browser.",
    "Ein interner Serverfehler ist aufgetreten.",
    "Hier steht Ihr Text.",
    "La page que vous recherchez est introuvable.",
    "Veuillez activer JavaScript pour continuer.",
    "Une erreur est survenue. Veuillez réessayer plus tard.",
    "Texte à venir",
    "Deze pagina kan niet worden gevonden.",
    "Schakel JavaScript in om deze site te gebruiken.",
    "No se ha encontrado la página.",
    "Por favor, active JavaScript en su navegador.",
    "Ha ocurrido un error inesperado. Inténtelo de nuevo más tarde.",
    "Página em construção",
    "A página solicitada não foi encontrada.",
    "Ative o JavaScript para continuar.",
    "Pagina non trovata",
    "Si è verificato un errore. Riprova più tardi.",
    "Per utilizzare questo sito è necessario abilitare JavaScript.",
    "Страница не найдена",
    "Пожалуйста, включите JavaScript в вашем браузере.",
    "Произошла ошибка. Повторите попытку позже.",
    "Nie znaleziono strony",
    "Proszę włączyć JavaScript w przeglądarce.",
    "Sayfa bulunamadı",
    "Bu siteyi kullanmak için JavaScript'i etkinleştirin.",
    "ページが見つかりません",
    "JavaScriptを有効にしてください。",
    "页面不存在",
    "请启用JavaScript后重试。",
    "الصفحة غير موجودة",
    "يرجى تفعيل جافا سكريبت في المتصفح.",
    "صفحہ نہیں ملا",
    "براہ کرم جاوا اسکرپٹ فعال کریں۔",
    "پیج لوڈ نہیں ہو سکا، دوبارہ کوشش کریں۔",
    "صفحه مورد نظر پیدا نشد",
    "पृष्ठ नहीं मिला",
    "कृपया जावास्क्रिप्ट सक्षम करें।",
]
CONTENT = [
    "[1]",
    "The figure is taken from the census of 1901 [1] and from a later survey [2].",
    "He wrote [sic] here and left the sentence as it stood.",
    "[Smith] replied that the ship had sailed.",
    "Let {a} be a set with one element and {b} another.",
    "Call __init__ before anything else and pass it the path.",
    "one two three",
    "The story of the lost page can not be found in any other edition of the poems.",
    "When a browser shows that JavaScript is disabled, readers see an empty page; the guide explains how to enable it.",
    "Our report lists every 404 error of last month and the pages that caused it.",
    "In the template, the placeholder {{name}} is replaced by the customer's name before the letter is sent.",
    "Write `${user}` where the name should appear.",
    "Printers have used the words lorem ipsum as filler since the sixteenth century, and nobody minds.",
    "The road was under construction for two years, and the shops along it suffered.",
    "Access to the valley was denied to travellers until the snow had melted.",
    "The server at the inn was out of order, so we poured our own tea.",
    "A table of prices: $5, $10, and $20 for the larger boxes.",
    "Array indices such as x[i] and y[j] are written in brackets.",
    "The sum of 20% and 30% is half of the whole.",
    "Use <b>bold</b> or <i>italic</i> type for titles.",
    "Die Seite des Buches konnte er nicht finden, weil sie herausgerissen war.",
    "Il a cherché la page pendant des heures sans la trouver dans le manuscrit.",
    "No se encontró la llave, pero la puerta estaba abierta.",
    "Книга лежала на столе, но нужная страница была вырвана.",
    "本のページをめくる音だけが聞こえた。",
    "他翻到最后一页，发现地图不见了。",
    "کتاب کا صفحہ پھٹا ہوا تھا لیکن متن پڑھا جا سکتا تھا۔",
    "اس سطر میں قلم کی سیاہی پھیل گئی ہے۔",
    "خط ۱۲ مارچ کو موصول ہوا اور اس کا جواب نہیں دیا گیا۔",
    "وجدنا الصفحة الأخيرة ممزقة في المخطوط القديم.",
    "किताब का आख़िरी पन्ना फटा हुआ था।",
    "Test results: three of the samples passed, two failed, one is missing.",
    "Testing, testing, one two three, said the singer, and the crowd laughed for a long time.",
    "See [Smith 1999, p. 12] and [Jones et al.] for details.",
    "The variable %PATH% holds the folders that are searched.",
    "Tomorrow's performance is coming soon after the long rehearsals of spring.",
    "An error occurred in the second edition: the king's name is misspelt throughout.",
    "Please try again later chapters if the first ones bore you.",
    "I was blocked by a cow on the way to the station and missed the train.",
    "The page is missing.",
    "(a) first, (b) second, (c) third",
    "To be confirmed in office, a bishop needed the king's consent.",
    "x y z",
    "a, b, c",
    "A null hypothesis is not the same as a null result.",
    "The word undefined has a plain meaning in mathematics.",
]


def texts_with_content_around(residue: str) -> str:
    """A residue line in a long text of ordinary sentences."""
    lines = [c for c in CONTENT if c[:1].isupper() and "{" not in c and "$" not in c][:8]
    return "\n".join([*lines[:4], residue, *lines[4:]])

# Written after the lists were settled; nothing was changed for it.
LATER_RESIDUE = [
    "Error establishing a database connection", "This site can't be reached", "ERR_CONNECTION_TIMED_OUT", "You don't have permission to access this resource.",
    "The page you requested has been moved or deleted.", "JavaScript is disabled in your browser.", "This website requires JavaScript to function properly.", "Please enable cookies and JavaScript, then refresh.",
    "Enter your text here", "[Your Name]\n[Street Address]", "Dear [Recipient],", "Hi {firstName}, thanks for joining.", "This is placeholder text.", "Sample text sample text sample text",
    "Fehler 404: Die angeforderte Seite existiert nicht.", "JavaScript muss aktiviert sein.", "Erreur 404 : page non trouvée", "Lo sentimos, la página solicitada no existe.",
    "Ошибка 500. Внутренняя ошибка сервера", "Включите JavaScript, чтобы продолжить.", "お探しのページは見つかりませんでした。", "您访问的页面不存在", "حدث خطأ، يرجى المحاولة لاحقا", "خرابی: صفحہ دستیاب نہیں",
]
LATER_CONTENT = [
    "He enabled the alarm before leaving the house.", "The database of birds holds four thousand species.", "Her name and address were written on the first page.",
    "The service was unavailable on Sundays, so the parish walked to the next village.", "Two files were missing from the drawer when the clerk came back.",
    "The connection between the two poems was not found until 1950.", "<i>Placeholder</i> is a word of two parts.", "Set {x, y} contains two points.", "Er hat die Tür geöffnet und ist gegangen.",
    "درخواست دفتر میں جمع کر دی گئی تھی۔", "La puerta no existe en el plano original del palacio.", "The test was hard and the second test was harder.",
]

# Written after the lists were widened for what LATER_RESIDUE had shown; nothing was changed for it.
LAST_RESIDUE = [
    "We're sorry, but something went wrong.", "Server Error in '/' Application.", "429 Too Many Requests", "The resource you are looking for has been removed or is temporarily unavailable.",
    "Your browser does not support JavaScript!", "Please enable JavaScript to view the comments.", "This content requires scripts to be allowed.", "Browser check in progress, please wait",
    "Click here to add text", "Replace this text with your own.", "Insert your headline here", "asdf asdf asdf", "Best regards,\n[Your Name]", "Order #{{order.number}} shipped",
    "Bitte schalten Sie JavaScript ein.", "Der Server ist vorübergehend nicht erreichbar.", "Cette page n'existe plus.", "JavaScript est désactivé.", "Página no disponible", "Страница не существует",
    "Strona nie została znaleziona", "ただいまメンテナンス中です。", "服务器错误,请稍后再试", "صفحہ لوڈ نہ ہو سکا، بعد میں کوشش کریں۔",
]
LAST_CONTENT = [
    "Click of the latch woke the child.", "The network of canals was dug in twelve years.", "Its best feature is the view over the harbour.", "Check the oil before every long drive.",
    "The order of the chapters differs in the second manuscript.", "The judge found that the contract does not exist.", "They failed to open the gate in time.", "[laughs] That was a long time ago.",
    "Sie müssen die Suppe eine Stunde kochen.", "Она искала книгу весь день и не нашла.", "دروازہ بند ہے اور چابی گم ہو گئی ہے۔", "Der Dienst im Krankenhaus war hart.",
]

# A fourth set, written just before the lists were widened for the last time and in sight then, so it is no measure.
FOURTH_RESIDUE = [
    "The system cannot find the file specified.", "Error 1020: Access denied", "This video is unavailable.", "Whoops, looks like something went wrong.", "Internal Server Error - Write",
    "Uncaught TypeError: Cannot read properties of undefined", "No such file or directory", "Request timed out.", "The connection has timed out", "Invalid or expired session token",
    "Please turn on JavaScript in your browser settings.", "JavaScript must be enabled in order to use this site.", "Complete the security check to access the site", "Loading, please wait...",
    "Type here to search", "Your logo here", "Add a caption", "Title goes here", "Description to be added later.", "Lorem ipsum dolor sit amet", "xxxxx xxxxx xxxx",
    "Thank you, {{ contact.firstname }}!", "Dear %CUSTOMER_NAME%,", "[Date]\n[Company Name]", "Hallo ${name}, willkommen!",
    "Sidan kunde inte hittas.", "Siden blev ikke fundet", "Stránka nenalezena", "페이지를 찾을 수 없습니다", "Không tìm thấy trang", "Halaman tidak ditemukan", "Сторінку не знайдено",
    "Die gewünschte Seite ist leider nicht verfügbar.", "Le serveur ne répond pas.", "El servidor no responde.", "アクセスが集中しています。しばらくしてから再度お試しください。", "网页无法访问", "الخادم لا يستجيب", "سرور دستیاب نہیں ہے۔ دوبارہ کوشش کریں۔", "یہاں متن درج کریں",
]
FOURTH_CONTENT = [
    "Wait for the tide, said the pilot, and keep the lamp lit.", "The captain added a caption to every photograph.", "The company logo was painted over in 1954.", "Please replace the lid after use.",
    "The search for the ship went on for a month.", "The new edition is unavailable in shops outside the city.", "They write the date in the upper corner.", "The session of parliament was long and dull.",
    "Hon kunde inte hitta sin bok.", "Er wartete lange, aber niemand kam.", "Le serveur apporta deux cafés.", "El camarero no responde a nadie.", "سرخ روشنائی سے لکھا ہوا عنوان مٹ گیا ہے۔", "彼は駅で長い間待っていた。",
]

# A fifth set, written after the last change of the lists; nothing was changed for it.
FIFTH_RESIDUE = [
    "Database error: too many open connections.", "Your request could not be processed.", "Sorry, this content isn't available right now.", "We're having trouble loading this page.", "HTTP 503 Service Unavailable",
    "PHP Fatal error: Allowed memory size of 134217728 bytes exhausted", "This feature requires JavaScript.", "You have JavaScript turned off.", "Enable JavaScript and cookies to continue", "Are you a robot?",
    "Caption text", "Insert picture here", "This section is intentionally left blank.", "Content coming soon", "Dear <FIRST_NAME>,", "{{#if user}}Hello{{/if}}", "Signed: [Signature]",
    "Diese Website benötigt JavaScript.", "Der Zugriff wurde verweigert.", "Erreur interne, veuillez réessayer.", "Tu navegador no admite JavaScript.", "Errore 500: qualcosa è andato storto", "Доступ к сайту ограничен",
    "Strona tymczasowo niedostępna", "エラー：ページを表示できません", "请开启浏览器的JavaScript功能", "تعذر تحميل الصفحة", "براؤزر میں جاوا اسکرپٹ بند ہے",
]
FIFTH_CONTENT = [
    "Memory of the fire was kept alive in songs.", "The trouble with the old pump was never solved.", "His request was processed within a week.", "This section of the wall is older than the gate.",
    "Robots build cars in the hall next door.", "The picture shows a river at night.", "The signature on the letter is hers.", "Der Zug hatte wegen Nebel Verspätung.", "La erupción duró dos días.", "کھڑکی بند تھی اور کمرے میں اندھیرا تھا۔",
]
