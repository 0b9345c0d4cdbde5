"""Pattern catalogue, in Java's dialect. Results must match those of the corpora they were made for."""

from __future__ import annotations

LETTER = "а-яА-ЯёЁa-zA-Z"
EMAIL = r"(?i)[a-zA-Z0-9_.+-]+\s*@\s*[a-zA-Z0-9-]+(?:\s*\.\s*[a-zA-Z]{2,})+"
URL = r"""(?i)https?\s*://\s*[^\s\)\]\}"'<>]+|ftp://[^\s]+"""
ACCESS_MODE = r"(?iu)[-–—]?\s*Режим доступа\s*:[^\n]{0,500}"
ACCESS_DATE = r"(?iu)\(?Дата обращения\s*:\s*\d{1,2}\.\d{1,2}\.\d{4}\.?\)?"
BIBLIOGRAPHY_HEADER = r"(?:Список\s+(?:литературы|источников?|использованн\S+\s+(?:литературы|источников?))|Литература|Библиографический\s+список|Библиография|References?|Bibliography)"
BIBLIOGRAPHY_LINE = r"(?iu)(?:^|\n)[ \t]*" + BIBLIOGRAPHY_HEADER + r"[ \t]*(?:\n|$)"
BIBLIOGRAPHY_INLINE = r"(?iu)(?<=[.!?])\s{1,5}" + BIBLIOGRAPHY_HEADER + r"(?=[ \t]{0,5}\d)"
URL_FRAGMENT = r"(?iu)[\w\-_.%]+/[\w\-_.%/]+\.(?:html?|pdf|php|xml|asp|aspx|cfm|do|shtml)\b"
URL_PATH = r"(?iu)(?<!\w)/[\w\-_.%/]+\.(?:html?|pdf|xml|php)\b"
CLASSIFICATION_LINE = r"(?imu)^[ \t]*(УДК|ББК|UDC|BBK|DOI)\b[^\n]*"
DOI = r"(?i)\b10\.\d{4,}/\S+"
AUTHORS_RU = r"(?isu)Сведения об авторах?\s*\n.+"
AUTHORS_EN = r"(?is)(Information about (the )?authors?|About (the )?authors?)\s*\n.+"
SOFT_HYPHEN = "­"
CONTROL = r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]"
FOOTNOTE_NUMBER = r"(?m)^\s*\d+[.)]\s+"
FOOTNOTE_BRACKET = r"(?m)^\s*\[\d+\]\s*"
KEYWORDS = r"(?iu)Ключевые\s+(?:слова\s+и\s+фразы|слова)\s*[:][,\s]*(?:[^\n]{0,1000}\n|[^\n]{0,800}?\.[ \t]*(?=\n|$|[А-ЯЁA-Z])|[^\n]{0,300})"
EMAIL_LINE = r"(?i)E[\s-]?mail\s*:\s*[^\n]{0,300}\n?"
SPACE_HYPHEN = rf"([{LETTER}])- +([{LETTER}])"
STRAY_BACKSLASH = r"""(?<=[»)\]"])[ \t]*\\[ \t]*"""
CITE_RU = r"(?iu)Как\s+цитировать\s+(?:статью|работу|публикацию)\s*:[^\n]{0,800}\n?"
CITE_EN = r"(?i)How\s+to\s+cite(?:\s+this\s+article)?\s*:[^\n]{0,400}\n?"
LINE_HYPHEN = rf"([{LETTER}])-[ \t]*\n[ \t]*([{LETTER}])"
REF_ROUND = r"\(\s*\d+(?:\s*[,;]\s*\d+)*\s*\)"
REF_SQUARE = r"\[\s*\d+(?:\s*[,;]\s*\d+)*\s*\]"

#: Lines of front matter: any of these at a line's start, or a known running header anywhere in it.
ISSN_LINE = r"(?iu)^(?:ISSN|ИССН|E-ISSN)\s*[\d\-–—X]{6,}"
ISSN_FULL_LINE = r"(?iu)^(?:ISSN|ИССН|E-ISSN)\s*[\d\-–—X]{6,}\s*$"
EDITORIAL_LINE = r"(?iu)^(?:Главный\s+редактор|Редакционн(?:ый|ая)\s+(?:совет|коллегия)|Редакция|Адрес\s+редакции|Издатель(?:ство)?|Постоянный\s+адрес\s+статьи)(?![\wа-яё])"
COPYRIGHT_LINE = r"^©\s*.+$"
ANNOTATION_LINE = r"(?iu)^(?:Аннотация|Abstract|Ключевые\s+слова|Keywords?|Key\s+words)\s*:?\s*$"
CLASSIFICATION_ONLY = r"(?iu)^(?:УДК|ББК|UDC|BBK)\s+[0-9./\[\]\s\-–—]+$"
SOURCE_LINE = r"(?iu)^(?:Адрес\s+(?:статьи|журнала)|Источник)\s*[:.]"
PUBLICATION_LINE = r"(?iu)^(?:Содержание\s+данного\s+номера|Дата\s+поступления\s+рукописи|Информация\s+о\s+возможности\s+публикации)(?![\wа-яё])"
DOI_LINE = r"(?i)^DOI\s*[:\s]?\s*10\.\d{4,}/\S+"
ORCID_LINE = r"(?i)^(?:ORCID|http://orcid\.org|https://orcid\.org)\b"
RUNNING_HEADER = r"(?iu)(?:РЕФЕРАТИВНЫЙ\s+ЖУРНАЛ|РОССИЙСКАЯ\s+АКАДЕМИЯ\s+НАУК|IZVESTIYA\s+VUZOV|НОВЫЕ\s+ИССЛЕДОВАНИЯ\s*>|Студенческий\s+научный\s+электронный\s+журнал|электронный\s+научный\s+журнал\s+www\.|ISSN\s+[\d\-–—X]{6,}\s+[A-Za-zА-Яа-яЁё])"
PORTAL_PROMPT = r"(?iu)Не\s+можете\s+найти\s+то,\s*что\s+вам\s+нужно\?[^\n]{0,240}"
PAGE_NUMBER = r"^\d{1,4}$"
CATALOGUE_LINE = r"^\s*-?\d+\s*\.\s*\d+\s*$|^\s*\d{2}\.\d{2}\.\d{2,4}\.?\s*$|^\s*\d{3}\s*$"
OCR_CATALOGUE = r"(?i)\b(?:2Q{2,}\w*|[A-Z]?\d*Q\d+(?:\.\d+){1,4})\b"
DIGIT_LETTER = r"(?U)\b\d+[A-Za-zА-Яа-яЁё]{1,3}\b|\b[A-Za-zА-Яа-яЁё]{1,3}\d+\b"
CAPTION_LINE = r"(?imu)^(?:Фото|Кадр|Видео|Снимок|Иллюстрация)\s*:\s*.{0,400}$"
ABSTRACT_MARK = r"(?i)(?:^|\n)Abstract\s*[:.]?\s*\n"
META_LINES = (ISSN_LINE, EDITORIAL_LINE, COPYRIGHT_LINE, ANNOTATION_LINE, CLASSIFICATION_ONLY, SOURCE_LINE, PUBLICATION_LINE, DOI_LINE, ORCID_LINE)

#: Where an article's tail begins: section headers, codes of a next article, titles in capitals.
TAIL_HEADER = r"(?iu)^(?:Список\s+(?:литературы|источников?|использованн\S+\s+литературы)|Библиографический\s+список|Библиография|Литература\s*$|Литература\s+\d|References?\s*$|Bibliography\s*$|Сведения\s+об\s+авторах?|Information\s+about\s+(?:the\s+)?authors?|About\s+(?:the\s+)?authors?|Для\s+цитирования|How\s+to\s+cite(?:\s+this\s+article)?\s*$|Статья\s+поступила|Принята\s+к\s+публикации|Annotation\s*$|Abstract\s*$|Keywords?\s*$|Key\s+words\s*$)"
NEXT_ARTICLE = r"(?iu)^(?:УДК|ББК|UDC|BBK)\s+[\d./\[\]\s\-–—]+$|^DOI\s*[:\s]?\s*10\.\d{4,}/\S+$|^(?:ISSN|ИССН|E-ISSN)\s*[\d\-–—X]{6,}\s*$"
CAPS_TITLE = r"""^[А-ЯЁA-Z][А-ЯЁA-Z0-9\s\-–—:,.«»"]{14,140}$"""
#: English metadata inside a Russian text: headers in the order they are tried, and where Russian goes on.
ENGLISH_HEADERS = (r"(?im)(?:^|\n)(?:Abstract|Summary|Annotation)\s*[:.]?\s*\n", r"(?i)\n(?:Abstract|Summary|Annotation)\s*[:.]\s+[A-Za-z]", r"(?im)(?:^|\n)Key\s*words?\s*[:.]\s*\S")
ENGLISH_TAIL_HEADERS = (r"(?im)(?:^|\n)(?:Abstract|Summary|Annotation|Key\s*words?)\s*[:.]?\s*\n", r"(?i)\n(?:Abstract|Summary)\s*[:.]\s+[A-Za-z]")
RUSSIAN_PARAGRAPH = r"\n\n(?=[ \t]*[А-ЯЁа-яё][^\n]{28,})"
RUSSIAN_TAIL_PARAGRAPH = r"\n\n(?=[ \t]*[А-ЯЁа-яё][^\n]{24,})"
RUSSIAN_LINE = r"\n(?=[А-ЯЁ][а-яё]{4,}\s)"
#: Menu and footer lines of portals.
RBC_FOOTER = r"(?iu)(?:Оставайтесь\s+на\s+связи\s+с\s+РБК|РБК\s+в\s+M[аa]х|РБК\s+в\s+Max|мессенджер[еа]?\s+M[аa]x|мессенджер[еа]?\s+Max|скачайте\s+приложение\s+РБК|rbc\.ru/(?:app|max)\b)"
PORTAL_LINES = {
    "pravda": r"(?iU)(?:^Использование\s+материалов\s+сайта\b|^Реклама\s+на\s+сайте\b|^Правил[аи]\s+использования\b|^Свидетельство\s+о\s+регистрации\b|^Новости\s*$|^Публикации\s*$|^Колонки\s*$|^Спецпроекты\s*$|^Радио\s*$|^Мультимедиа\s*$|^Подписка\s*$|редакци[ия]\s*[:.]\s*|^©\s*\d{4}\b.*Правда)",
    "pravda_ua": r"(?iU)(?:^Реклама\s+на\s+сайте\b|^Правила\s+использования\s+материалов\b|^Политика\s+ИИ\b|^Гендерная\s+политика\b|^Как\s+писать\s+для\s+УП\b|^Стажировка\b|^Использование\s+материалов\s+сайта\b|^Умови\s+використання\b|^Політика\s+ІІ\b|редакци[ия]\s*[—\-]\s*газет|Редакція\s*[:\-]|^redaction@|^press@|@pravda\.com\.ua\b|^Тел\.?\s*[:\-]?\s*\+|Tel\.?\s*[:\-]?\s*\+380)",
    "pikabu": r"(?iU)(?:Подписаться|Спасибо,\s*что\s+подписались|Лучшие\s+посты\s+недели|Реклам[аы]\s+на\s+Пикабу|Пикабу[\s\-]*пост|Сообщество\s+авторов|^Теги:?\s*$|^Похожие\s+посты|^Ещё\s+посты|^Комментарии\s+\d|^Юмор\s*$|^Здоровье\s*$|^Бизнес\s*$|^Транспорт\s*$|^Наука\s*$|^Моё\s*$|^IT\s*$)",
    "mail_ru": r"(?iU)(?:^Mail\.Ru\b|@mail\.ru\s*$|Почта\s+Mail|Пользовательское\s+соглашение|^Реклама\s*$)",
}
PRAVDA_UA_MENU = r"(?iU)(?:\bНовости\s+Публикации\s+Колонки\b|\bПубликации\s+Колонки\s+Интервью\b|\bНовости\s+Публикации\s+Колонки\s+Интервью\b|\bАрхів\s+новин\b|\bГоловна\s+—\s+УП\b)"

#: Phrases of a model that declines.
REFUSALS = (
    "я не могу помочь",
    "я не могу выполнить",
    "я не могу предоставить",
    "извините, но я не могу",
    "не могу помочь с этим",
    "i can't help with that",
    "i cannot help with that",
    "i can't assist with that",
    "i’m sorry, but i can’t",
    "i am sorry, but i can't",
)
#: The refusal of a service, which generated texts may carry.
SERVICE_REFUSAL = "я не могу обсуждать эту тему. давайте поговорим о чём-нибудь ещё"
#: Stems of sensitive topics.
TOPICS = {
    "religion": ["религ", "церков", "христиан", "ислам", "будд", "православ", "мусульман", "коран", "библи", "священ", "вера", "богослов", "бог"],
    "politics": ["полит", "государств", "власть", "парти", "выбор", "депутат", "президент", "конституц", "санкц", "идеолог", "режим", "геополит"],
    "philosophy": ["философ", "онтолог", "эпистем", "гносеолог", "метафиз", "экзистен", "сознани", "бытие", "этика", "аксиолог", "герменевт"],
}
#: Phrases of a prompt that leaked into an answer: one strong or two medium ones.
LEAKS_STRONG = (
    r"(?iU)^\s*вот\s+переработан",
    r"(?iU)^\s*вот\s+продолжени",
    r"(?iU)^\s*ниже\s+приведен",
    r"(?iU)^\s*конечно[,!\s]",
    r"(?iU)^\s*output\s+only\b",
    r"(?iU)^\s*translate\s+the\s+following\b",
    r"(?iU)\byou\s+are\s+a\s+professional\s+translator\b",
    r"(?iU)\bты\s+редактор\b",
    r"(?iU)\bты\s+—\s+редактор\b",
    r"(?iU)\bты\s+соавтор\b",
    r"(?iU)\bтолько\s+текст\s+фрагмента\b",
    r"(?iU)\bпродолжай\s+отсюда\b",
)
LEAKS_MEDIUM = (
    r"(?iU)\btext:\b",
    r"(?iU)\bfragment:\b",
    r"(?iU)\bфрагмент:\b",
    r"(?iU)\bтолько\s+продолжение\b",
    r"(?iU)\bбез\s+пояснений\b",
)
#: Instructions aimed at a judging model.
INJECTIONS = (
    r"(?iU)пропусти\s+(?:этот\s+)?текст",
    r"(?iU)считай\s+(?:это|текст)\s+(?:человеческим|human)",
    r"(?iU)поставь\s+(?:вердикт\s+)?(?:human|человек)",
    r"(?iU)игнорируй\s+(?:предыдущие\s+)?инструкци",
    r"(?iU)ignore\s+(?:previous\s+)?instructions",
    r"(?iU)это\s+(?:тестовый|проверочный)\s+текст",
    r"(?iU)ты\s+должен\s+(?:вынести|поставить)\s+вердикт",
    r"(?iU)твой\s+вердикт\s+должен\s+быть",
    r"(?iU)считай\s+что\s+это\s+написал",
    r"(?iU)представь\s+что\s+это",
    r"(?iU)BERT\s+ошибается",
    r"(?iU)DetectGPT\s+(?:не\s+прав|ошибается)",
    r"(?iU)технические\s+сигналы\s+неверны",
    r"(?iU)\[system\]|\[user\]|\[assistant\]",
    r"(?iU)<\|im_start\|>|<\|im_end\|>",
    r"(?iU)disregard\s+all\s+previous",
    r"(?iU)pretend\s+you\s+are",
    r"(?iU)you\s+must\s+(?:respond|answer|say)",
)
