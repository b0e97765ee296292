"""Wording of residue, as data.

Collected from public wording: reason phrases of HTTP (RFC 9110) and their usual translations, default
error pages of common web servers, blogs and content systems, notices of browsers and bot checks, the
usual ``noscript`` texts, messages of interpreters and databases, placeholder texts of office and web
templates, and the pseudo-Latin filler. Phrases are parted by ``|``; letter case, apostrophes and
diacritics of Arabic script don't count, and 0 stands for any run of digits.

Strong phrases make a unit residue if enough of its words are covered; glue only covers.
"""

# Errors, by language.
ERRORS = {
    "en": """
access denied|permission denied|unauthorized|not authorized|not authorised|access to this page has been denied|you have been blocked|unable to access

file or directory not found|page not found|has been moved or deleted|bad request|bad gateway|gateway timeout|gateway time out|service unavailable|temporarily unavailable
internal server error|server error|http error 0|error 0|error code 0|status 0|status code 0|http 0|http 0 0 0|too many requests|too many connections|request timeout|took too long to respond|method not allowed
payload too large|0 gone|session expired|an unexpected error|an unknown error|an unexpected fault|an unknown fault|unexpected error|unknown error|something went wrong
unable to connect|connection refused|connection timed out|connection reset|connection closed|remote end hung up
upstream connect error|before headers were read|invalid response|invalid answer|try again later|try again in a few minutes|contact the site owner|contact the administrator|contact support|go back to the start page
down for maintenance|undergoing maintenance|unable to handle your request|over capacity|log in again|sign in again
failed to fetch|could not connect|no data received|exited with code 0|out of memory
stack trace|traceback most recent call last|core dumped|segmentation fault|broken pipe|fatal error|parse error|syntax error|uncaught exception|unhandled exception|on line 0|py line 0|php on line 0|line 0 in|in main
keyerror|oserror|ioerror|valueerror|runtimeerror|typeerror|indexerror|attributeerror|nullpointerexception|memory size exhausted|call to undefined function|undefined index|undefined variable|no such file or directory|cannot find the file|cannot read properties|is not defined|is not a function|null reference|unhandled|server not responding|not responding|does not respond|invalid session|invalid token|expired session|content type text html
""",
    "de": "seite nicht gefunden|nicht verfügbar|antwortet nicht|reagiert nicht|nicht geladen werden|konnte nicht gefunden werden|nicht gefunden|ist nicht verfügbar|nicht erreichbar|zugriff verweigert|kein zugriff|interner serverfehler|serverfehler|fehler 0|ein fehler ist aufgetreten|ist aufgetreten|ist ein fehler aufgetreten|bitte versuchen sie es später|versuchen sie es später erneut|sitzung ist abgelaufen|zeitüberschreitung|wartungsarbeiten",
    "fr": "page introuvable|ne répond pas|non disponible|indisponible|est introuvable|introuvable|page non trouvée|nexiste pas|nexiste plus|accès refusé|accès interdit|erreur interne du serveur|erreur serveur|erreur 0|une erreur est survenue|une erreur sest produite|veuillez réessayer|réessayer plus tard|service indisponible|session a expiré|en maintenance",
    "es": "página no encontrada|no responde|no disponible|no está disponible|no se ha encontrado|no se encontró|no encontrada|no existe|acceso denegado|acceso prohibido|error interno del servidor|error del servidor|error 0|ha ocurrido un error|se ha producido un error|ocurrió un error|un error inesperado|inténtelo de nuevo|inténtalo de nuevo|vuelva a intentarlo|servicio no disponible|sesión ha caducado|sesión ha expirado|en mantenimiento",
    "pt": "página não encontrada|não responde|não disponível|indisponível|não foi encontrada|não foi encontrado|não encontrada|não existe|acesso negado|erro interno do servidor|erro no servidor|erro 0|ocorreu um erro|erro inesperado|tente novamente|serviço indisponível|sessão expirou|em manutenção",
    "it": "pagina non trovata|non risponde|non disponibile|non trovata|non è stata trovata|non esiste|accesso negato|errore interno del server|errore del server|errore 0|si è verificato un errore|errore imprevisto|riprova più tardi|si prega di riprovare|riprovare più tardi|servizio non disponibile|sessione è scaduta|sessione scaduta|in manutenzione",
    "nl": "pagina niet gevonden|reageert niet|niet worden gevonden|niet gevonden|kan niet worden|bestaat niet|toegang geweigerd|interne serverfout|serverfout|fout 0|er is een fout opgetreden|is opgetreden|er ging iets mis|er is iets misgegaan|probeer het later opnieuw|probeer het opnieuw|niet beschikbaar|sessie is verlopen",
    "pl": "nie znaleziono|nie została znaleziona|strona nie istnieje|nie istnieje|odmowa dostępu|brak dostępu|wewnętrzny błąd serwera|błąd serwera|błąd 0|wystąpił błąd|spróbuj ponownie|usługa niedostępna|sesja wygasła",
    "ru": "страница не найдена|не найдена|не найдено|не найден|не существует|доступ запрещен|доступ запрещён|внутренняя ошибка сервера|ошибка сервера|ошибка 0|произошла ошибка|повторите попытку|попробуйте позже|попробуйте еще раз|сервис недоступен|временно недоступен|сессия истекла",
    "tr": "sayfa bulunamadı|bulunamadı|mevcut değil|erişim engellendi|erişim reddedildi|sunucu hatası|hata 0|bir hata oluştu|tekrar deneyin|daha sonra tekrar deneyin|hizmet kullanılamıyor|oturumunuz sona erdi",
    "ja": "見つかりません|アクセスが集中して|表示できません|応答がありません|見つかりませんでした|存在しません|アクセスが拒否されました|アクセスできません|サーバーエラー|内部エラー|エラー 0|エラーが発生しました|再度お試しください|もう一度お試しください|メンテナンス中|ご利用いただけません",
    "zh": "页面不存在|无法访问|无法显示|没有响应|不存在|未找到|找不到|无法找到|無法找到|找不到頁面|拒绝访问|访问被拒绝|禁止访问|服务器错误|内部错误|错误 0|发生错误|出错了|请稍后再试|請稍後再試|服务不可用|系统维护",
    "ar": "الصفحة غير موجودة|لا يستجيب|لا يمكن الوصول|غير موجودة|لم يتم العثور على|تم رفض الوصول|الوصول مرفوض|خطأ 0|خطأ في الخادم|حدث خطأ|خطأ غير متوقع|حاول مرة أخرى|يرجى المحاولة لاحقا|الخدمة غير متاحة|غير متاحة|انتهت الجلسة",
    "fa": "پیدا نشد|یافت نشد|وجود ندارد|دسترسی غیر مجاز|دسترسی غیرمجاز|خطای 0|خطای سرور|خطای داخلی|خطایی رخ داد|رخ داد|خطای غیر منتظره|دوباره تلاش کنید|در دسترس نیست",
    "ur": """
صفحہ نہیں ملا|نہیں ملا|نہیں ملی|نہیں مل سکا|نہیں مل سکی|موجود نہیں|دستیاب نہیں|رسائی ممنوع|اجازت نہیں|دیکھنے کی اجازت|اندرونی خرابی|سرور کی خرابی|خرابی 0|غلطی 0|نقص 0|نمبر 0|خرابی پیش آئی|خرابی پیش آ گئی|خرابی واقع ہوئی|کچھ غلط ہو گیا
لوڈ نہ ہو سکا|لوڈ نہ ہو سکی|لوڈ نہیں ہو سکا|لوڈ نہیں ہو سکی|کھل نہ سکا|کھل نہ سکی|مکمل نہ ہوئی|مکمل نہ ہو سکی|مکمل نہیں ہو سکا|رد ہوئی|رد کر دی گئی|جواب نہیں دے رہا|رابطہ منقطع|مصروف ہے|عارضی طور پر بند|ہٹا دیا گیا|ہٹا دی گئی
وقت ختم|مہلت ختم|دوبارہ کوشش کریں|دوبارہ کوشش کیجیے|بعد میں کوشش کریں|بعد کوشش کریں|دوبارہ لاگ ان|منتظم سے رابطہ|واپس جائیں
""",
    "sv": "sidan hittades inte|sidan kunde inte hittas|hittades inte|kunde inte hittas|finns inte|åtkomst nekad|internt serverfel|serverfel|fel 0|ett fel uppstod|ett fel har uppstått|försök igen|inte tillgänglig",
    "da": "siden blev ikke fundet|siden findes ikke|ikke fundet|findes ikke|adgang nægtet|serverfejl|fejl 0|der opstod en fejl|prøv igen|siden ble ikke funnet|ikke funnet|ingen tilgang|det oppstod en feil|feil 0",
    "fi": "sivua ei löytynyt|ei löytynyt|ei löydy|pääsy estetty|palvelinvirhe|virhe 0|tapahtui virhe|yritä uudelleen",
    "cs": "stránka nenalezena|stránka nebyla nalezena|nenalezena|nebyla nalezena|neexistuje|přístup odepřen|chyba serveru|chyba 0|došlo k chybě|zkuste to znovu|stránka sa nenašla",
    "hu": "az oldal nem található|nem található|hozzáférés megtagadva|szerverhiba|hiba 0|hiba történt|próbálja újra",
    "ro": "pagina nu a fost găsită|nu a fost găsită|nu există|acces interzis|eroare de server|eroare 0|a apărut o eroare|încercați din nou",
    "el": "η σελίδα δεν βρέθηκε|δεν βρέθηκε|σφάλμα 0|σφάλμα διακομιστή|προέκυψε σφάλμα|δοκιμάστε ξανά",
    "uk": "сторінку не знайдено|не знайдено|доступ заборонено|помилка сервера|помилка 0|сталася помилка|спробуйте пізніше",
    "ko": "페이지를 찾을 수 없습니다|찾을 수 없습니다|존재하지 않습니다|접근이 거부되었습니다|서버 오류|오류 0|오류가 발생했습니다|다시 시도해 주세요",
    "vi": "không tìm thấy trang|không tìm thấy|không tồn tại|truy cập bị từ chối|lỗi máy chủ|lỗi 0|đã xảy ra lỗi|vui lòng thử lại",
    "id": "halaman tidak ditemukan|tidak ditemukan|akses ditolak|kesalahan server|kesalahan 0|terjadi kesalahan|silakan coba lagi|coba lagi",
    "he": "הדף לא נמצא|לא נמצא|הגישה נדחתה|שגיאת שרת|שגיאה 0|אירעה שגיאה|נסה שוב",
    "hi": "पृष्ठ नहीं मिला|नहीं मिला|पेज नहीं मिला|उपलब्ध नहीं है|पहुँच अस्वीकृत|त्रुटि 0|सर्वर त्रुटि|त्रुटि हुई|पुनः प्रयास करें|फिर से प्रयास करें|बाद में प्रयास करें",
}
# Errors that happen to other things too; they count beside a thing of THINGS only.
ERRORS_OF_THINGS = """
unavailable|is unavailable|not responding|no longer valid|has been disabled|has been deactivated|cannot be displayed|cannot be loaded|was not found|were not found|is missing|no response
not found|cannot be found|cant be found|could not be found|couldnt be found|cant find|couldnt find|cannot find|does not exist|doesnt exist|no longer exists|no longer available|nothing was found|has been removed|forbidden|timed out|has expired|has timed out|isnt working|is not working|isnt available|is not available|not available right now|cant be reached
cannot be reached|an error occurred|an error has occurred|error occurred|overloaded|failed to load|failed to open|could not be loaded|could not be opened|could not be read|could not be displayed|no output|returned nothing|returned no data|exited|has failed|failed|crashed|aborted|you do not have permission|you dont have permission|may not view|has no right to|please try again|may not
"""
THINGS = """
page|pages|file|files|document|folio|scan|image|url|link|address|site|website|app|application|server|servers|host|gateway|proxy|database|service|system|process|worker|job|task|model|engine|recogniser|recognizer|recognition|checkpoint|session|connection|request|response|resource|viewer|script|error 0|code 0|browser|account|upload|download
seite|server|serveur|servidor|服务器|网页|網頁|サーバー|الخادم|سرور|sidan|siden|oldal|stránka|halaman|página|pagina|strona|strony|страница|sayfa|ページ|页面|頁面|الصفحة|صفحہ|صفحه|पृष्ठ|पेज
"""
# Notices that scripts are required and checks of the browser.
SCRIPTS = """
자바스크립트를|javascript|java script|scripting|scripts|noscript|script enabled|script enabled browser|enable js|activate js|turn on js|switch on js|allow js|requires js|needs js|without js
checking your browser|verifying your browser|verifying you are human|verify you are human|are you a robot|not a robot|just a moment|attention required|enable cookies|browser check|security check|captcha|please wait|one moment please|ddos protection|loading
جاوا اسکرپٹ|جاوااسکرپٹ|اسکرپٹ|جافا سكريبت|جافاسكريبت|جاوا اسکریپت|جاوااسکریپت|जावास्क्रिप्ट|джаваскрипт
"""
# Fillers and texts that announce text.
FILLERS = """
will appear here|goes here|text here|title here|description here|content here|name here|insert text|add your|enter your|type your|write your|write this part|insert image|lorem text
coming soon|under construction|content to follow|text to follow|details to follow|to follow|to be added|to be written|to be replaced|to be confirmed|to be determined|to be announced|to be completed
tbd|t b d|tbc|tba|todo|fixme|placeholder|for layout only|for position only|do not publish|temporary text|dummy text|filler text|sample text|sample copy|sample sentence|stand in wording|only a sample|this is a sample|untitled document|your text
replace this text|edit this text|click to add|click to edit|click here to add|type here|add a caption|add caption|add a title|add text|your logo|your headline|your title here|insert your|your own text|image here|caption here|heading here|added later|more text here
hier steht ihr text|hier text einfügen|platzhalter|blindtext|demnächst verfügbar|im aufbau|in kürze|folgt in kürze|inhalt folgt
texte à venir|à venir|bientôt disponible|votre texte ici|texte de remplissage|faux texte|en construction|à compléter
próximamente|su texto aquí|texto de ejemplo|texto de relleno|en construcción|por completar|em breve|seu texto aqui|texto de exemplo|em construção
prossimamente|il tuo testo qui|testo di esempio|in costruzione|binnenkort beschikbaar|uw tekst hier|voorbeeldtekst|wkrótce|twój tekst|przykładowy tekst|w budowie
скоро|ваш текст|пример текста|в разработке|текст заполнитель|yakında|metin buraya|örnek metin|yapım aşamasında
準備中|近日公開|ここにテキスト|サンプルテキスト|ダミーテキスト|敬请期待|即将推出|在此输入|示例文本|建设中
سيظهر النص هنا|نص تجريبي|قريبا|قيد الإنشاء|أدخل النص|متن آزمایشی|به زودی|در دست ساخت|متن خود را|जल्द आ रहा है|नमूना पाठ|निर्माणाधीन
آئے گا|یہاں متن|یہاں عبارت|یہاں تفصیل|یہاں مضمون|درج ہوگا|شامل ہوگا|شامل ہوگی|بعد میں لکھا جائے گا|کچھ نہیں لکھا گیا|ابھی باقی ہے|جلد آ رہا ہے|زیر تعمیر
عارضی تحریر|عارضی متن|عارضی عبارت|نمائشی عبارت|نمائشی متن|نمائشی تحریر|فرضی تحریر|فرضی عبارت|فرضی متن|صرف جگہ بھرنے کے لیے|نمونے کے طور پر|نمونے کی عبارت|نمونہ متن
"""
# English function words; they count neither as covered nor as words of a unit.
FUNCTION_WORDS = """please then and or of to for on at in with from the a an this that these it its we you your youre our is are was were has have had be been must will can not no before after while during when if by any only still again now there also so"""
# What stands around such phrases, and things that errors and notices are about.
GLUE = """
oops|whoops|sorry|were sorry|we are sorry|unfortunately|error|warning|notice|attention|kindly
page|pages|file|files|document|documents|folio|scan|scans|image|images|picture|text|content|contents|description|transcription|copy|wording|summary|remark|notes|title|paragraph|sentence|sentences|section|box|part|line|word|end|app|application|site|website|web|portal|address|url|link|viewer|reader|editor
server|servers|host|port 0|port|gateway|proxy|database|store|storage|service|services|system|process|worker|worker 0|job|task|model|engine|recogniser|recognizer|recognition|checkpoint|pixels|shelf|account|session|user|connection|request|requests|response|answer|query|timeout|code|ref|reference|id|r0|ray|nginx|apache|apache 0|nginx 0|microsoft|cloudflare
requested|looking|looking for|wanted|may|should|could|would|problem|continues|continue|loading|load|open|view|viewing|show|see|get|find|run|running|use|using|need|needs|requires|required|depends|works|work|wont|start|cannot|cant|dont|does|do|draw|needed|refresh|reload|restart|retry|return|back|home|minutes|minute|few|moment|later|soon|here|there
access|accessing|establishing|establish|function|functioning|properly|correctly|best|experience|order|resource|resources|database connection|data|feature|features|display|displayed|proceed|following|above|button|click|tap|device|internet|specified|invalid|expired|token|wait|progress|settings|complete|looks|like|read|properties|video|headline|logo|caption|own|edit|search|type|replace|network|offline|check|enable|enabled|enabling|activate|allow|allowed|turn|turn on|turn off|switch|switch on|switched off|off|disabled|disable|blocked|blocking|blocker|active|support|supports|supported|browser|browsers|cookies|client side|client|appears|client|http|https|html|status|detail|details|message|main|load|recognise|recognize|var|www|php|index|py|get|mysqli|connect|human|verifying|checking|ip|request|security|introduction|write|add|sample|dummy|temporary|stand in|real|example|quick|repeats|replaced|wird|published
sie|es|bitte|gewünschte|angefragte|die|der|das|diese|seite|muss|müssen|sein|ist|deaktiviert|aktiviert|existiert|versuchen|fortzufahren|benötigt|diesen|dienst|anmelden|in|ihrem|ihr|browser|aktivieren|und|wurde|werden|auf|um|zu|erneut|später|gesuchte|angeforderte|ein|fehler|text|leider|website|hier|interner|konnte
la|le|les|que|serveur|vous|doit|être|activé|désactivé|nécessite|fonctionner|afin|recherchez|demandée|page|pour|continuer|veuillez|activer|votre|navigateur|dans|est|et|une|erreur|plus tard|désolé|désolés|cette|du|de|un|activez|site|utiliser|ce
el|los|por|servidor|favor|debe|estar|activado|desactivado|requiere|funcionar|necesita|active|activar|habilite|su|navegador|en|que|busca|solicitada|página|para|continuar|más|tarde|lo sentimos|una|se|este|sitio|esta
o|os|servidor|ative|ativar|habilite|no seu|navegador|para continuar|a|página|solicitada|que você|procura|mais tarde|desculpe|um|do|da|este|site
per|utilizzare|questo|sito|è|necessario|abilitare|attivare|nel|tuo|browser|continuare|più|tardi|spiacenti|pagina|richiesta|che|stai|cercando|un|il|lo
deze|pagina|kan|schakel|in|om|te|gebruiken|site|uw|browser|de|het|een|alstublieft|sorry|opgevraagde
proszę|włączyć|włącz|w|przeglądarce|strony|strona|stronę|aby|kontynuować|szukana|później|przepraszamy|ta|ponownie
пожалуйста|включите|чтобы|продолжить|отключен|отключён|требуется|необходимо|работает|войдите|в|вашем|браузере|для|продолжения|страница|запрашиваемая|позже|извините|попытку|и|на|этот|сайт|к сожалению|работы
vänligen|aktivera|slå på|i din webbläsare|webbläsare|venligst|aktiver|i din browser|povolte|prosím|prohlížeči|kérjük|engedélyezze|vă rugăm|activați|увімкніть|будь ласка|자바스크립트를|활성화해|주세요|vui lòng|bật|trình duyệt|silakan|aktifkan|di browser|anda
lütfen|tarayıcınızda|etkinleştirin|bu|siteyi|kullanmak|için|sayfa|aradığınız|üzgünüz|daha sonra|devam etmek|i|i etkinleştirin
です|ただいま|います|しています|から|してから|お探しのページ|ページが|ページは|は|が|を|に|の|で|ください|してください|有効にして|有効に|ブラウザ|お使いの|申し訳ございません|申し訳ありません|後ほど|しばらく|して|再読み込み
请|启用|后|重试|您|访问|的|页面|浏览器|在|中|并|刷新|以|继续|抱歉|很抱歉|该|此|网站|開啟|请求
يرجى|تفعيل|في|المتصفح|الصفحة|المطلوبة|عذرا|لاحقا|من|فضلك|متصفحك|هذا|الموقع|على|أن|التي|تبحث|عنها|لمتابعة
صفحه|مورد|نظر|لطفا|مرورگر|خود|را|در|فعال|کنید|متاسفانه|از|برای|این|سایت|بعدا|متأسفیم
कृपया|सक्षम|करें|अपने|ब्राउज़र|में|क्षमा|इस|साइट|के|लिए|को|पेज|पृष्ठ|बाद
افسوس|معذرت|معاف کیجیے|مطلوبہ|پیج|صفحہ|ورق|تصویر|دستاویز|درخواست|فائل|متن|عبارت|تفصیل|مضمون|پیراگراف|جملہ|ذیل|حوالہ|آپ|سرور|نظام|ویب گاہ|ویب|سائٹ|براؤزر|ناظر|کوکیز|رابطہ|کوڈ|خرابی|غلطی|نقص
بند|روک|دی|دیا|گئی|گیا|فعال|فعال نہیں|کھول|کھل|لوڈ|چلنے|آن|اجازت|آگے|بڑھنے|پڑھنے|دیکھنے|چلانے|استعمال|استعمال کرنے|براہ کرم|برائے مہربانی|مہربانی|لیے|عارضی|طور|ابھی|فی الحال|بعد|دیر|کچھ|اصل|جگہ|یہاں|دوبارہ|کوشش|منتظم|لاگ ان|حاصل|ضروری|کرنا|ہوگا|نمبر
میں|سے|کا|کی|کے|کو|پر|تک|نے|اور|یا|یہ|وہ|اس|ہے|ہیں|ہو|ہوا|ہوئی|تھا|نہیں|نہ|بغیر|کر|کریں|کیجیے|کیجئے|دیں|دیجیے|کرتا|سکتا|رکھا|لکھا|0
"""
# Words of the usual pseudo-Latin filler, and plain words that make filler when a unit holds nothing else.
LOREM_WORDS = """lorem ipsum dolor dolore sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua enim
minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit
esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa officia deserunt mollit anim"""
DUMMY_WORDS = """blah bla yada foo bar baz qux test tests testing check abc xyz text words word line etc
آزمائش جانچ ٹیسٹ متن سطر لفظ شسدف جکل ییی ا ب پ ت ٹ ث ج"""
#: Of the plain words, those that alone are ordinary: numbers in words count only beside others.
NUMBER_WORDS = "one two three four"

# Delimiters of fields. Those of template languages are strong: what they hold is a field.
# Weak ones are used for much else: what they hold must look like a field's name.
STRONG_DELIMITERS = (
    ("{{", "}}"), ("{ {", "} }"), ("{%", "%}"), ("<%", "%>"), ("${", "}"), ("%(", ")s"), ("[[", "]]"), ("<<", ">>"), ("##", "##"), ("@@", "@@"), ("%%", "%%"),
)
WEAK_DELIMITERS = (("[", "]"), ("{", "}"), ("<", ">"), ("$", "$"), ("%", "%"), ("__", "__"), ("«", "»"), ("(", ")"))
# Names that fields of forms, letters and records have, and words that tell to fill something in.
FIELD_NAMES = """
name|first name|last name|full name|surname|title|subject|date|day|month|year|time|address|street|city|zip|country|phone|phone number|telephone|email|e mail|mail|company|company name|organization|organisation
recipient|sender|customer|client|user|username|author|editor|reviewer|operator|owner|signature|amount|price|quantity|number|id|reference|description|summary|url|page|page number|page title|folio|shelf mark|scan date|placeholder
vorname|nachname|datum|anrede|straße|ort|firma|betreff|nom|prénom|adresse|société|ville|nombre|apellido|fecha|dirección|empresa|ciudad|nome|sobrenome|data|endereço|cognome|indirizzo|naam|adres|имя|фамилия|дата|адрес|компания|ad|soyad|tarih
نام|تاریخ|عنوان|پتہ|جلد|کاتب|صفحہ نمبر|مہر نمبر|دستخط|مصنف|مقام|شہر|فون|رقم|الاسم|التاريخ|العنوان|آدرس|名前|日付|住所|姓名|日期|地址
"""
FILL_IN = """
insert|enter|your|add|type|fill in|fill|put|choose|select|here|to be filled|einfügen|ihr|ihre|hier|eingeben|insérer|votre|saisir|ici|insertar|ingrese|su|aquí|inserir|seu|aqui|inserisci|qui|vul in|hier|uw|wpisz|tutaj|введите|вставьте|ваш|buraya|girin|入力|输入|此处|أدخل|هنا|وارد کنید|اینجا
یہاں|درج کریں|درج کیجیے|لکھیں|لکھیے|آئے گا|آئے گی|پر کریں|پر کیجیے|بھریں|डालें|यहाँ
"""
#: Values that a template leaves when it is filled with nothing.
EMPTY_VALUES = ("null", "none", "nan", "undefined", "[object object]")
# Names of HTML elements; in angle brackets they are markup, not fields.
HTML_ELEMENTS = """a abbr b blockquote body br code div em figure font footer form h0 h1 h2 h3 h4 h5 h6 head header hr html i img input li
link main meta nav noscript ol option p pre script section select small span strong style sub sup table tbody td th thead title tr u ul"""
