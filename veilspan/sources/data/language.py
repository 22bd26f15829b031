"""The language rules that come with the engine: category, kind, priority, pattern."""

# Patterns and priorities that decide what is found. In the pattern of website_url the bracket inside the
# class is escaped, as Java needs it.
RULES = (
    ('person_name', 'regex', 1, '\\b[А-ЯЁ][а-яё]+\\s+[А-ЯЁ][а-яё]+\\s+[А-ЯЁ][а-яё]+\\b'),
    ('person_name', 'regex', 1, '\\b[А-ЯЁ][а-яё]+\\s+[А-ЯЁ]\\.[\\s\\xa0]*[А-ЯЁ]\\.'),
    ('person_name', 'regex', 1, '\\b[А-ЯЁ]\\.[\\s\\xa0]*[А-ЯЁ]\\.[\\s\\xa0]+[А-ЯЁ][а-яё]+\\b'),
    ('person_name', 'regex', 1, '\\b[А-ЯЁ]\\.[\\s\\xa0]*[А-ЯЁ]\\.[\\s\\xa0]*[А-ЯЁ][а-яё]+\\b'),
    ('person_name', 'regex', 2, '\\b[А-ЯЁ][а-яёА-ЯЁ]+[\\s\\xa0]+[А-ЯЁ][а-яёА-ЯЁ]+(?:\\b(?![\\s\\xa0]+[А-ЯЁ][а-яёА-ЯЁ]+))'),
    ('person_name', 'regex', 2, '\\b[А-ЯЁ][а-яёА-ЯЁ]{1,14}[\\s\\xa0]+[А-ЯЁ][а-яёА-ЯЁ]{2,14}(вич(а|у|ем|е|и|ём|ах|ам|ами)?|вна(я|е|ю|ой|ою|и|ях|ям|ями)?|чна(я|е|ю|ой|ою|и|ях|ям|ями)?|глы|лы)\\b'),
    ('position', 'spacy_context', 1, ''),
    ('organization', 'regex', 1, '(?i)\\b(общество с ограниченной ответственностью|обществ[ауое]м? с ограниченной ответственность[юи]|акционерное общество|акционерног[оа] обществ[ауо]м?|закрытое акционерное общество|закрытог[оа] акционерног[оа] обществ[ауо]м?|открытое акционерное общество|открытог[оа] акционерног[оа] обществ[ауо]м?|публичное акционерное общество|публичног[оа] акционерног[оа] обществ[ауо]м?|холдинг(а|у|ом|е)?)\\s+[«"\']?[А-ЯЁа-яё\\s\\-]+[»"\']?'),
    ('organization', 'regex', 1, '\\b(ООО|АО|ПАО|ЗАО|ИП|ГУП|МУП|ГБУ|МБУ|ФГБУ|ФГУП)\\s+[А-ЯЁа-яё\\s]*[«"\']?[А-ЯЁа-яё\\s\\-]+[»"\']?'),
    ('organization', 'regex', 1, '(?i)\\b(министерств[оа]|департамент[а]?|агентств[оа]|служб[аы])\\s+[а-яёА-ЯЁ]+(?:\\s+[а-яёА-ЯЁ]+){1,6}'),
    ('organization', 'spacy_ner', 2, ''),
    ('department', 'regex', 1, '\\b(отдел|управление|департамент|служба|сектор)\\s+[А-ЯЁа-яё\\s]+'),
    ('salary', 'regex', 1, '\\b(зарплата|оклад|заработная\\s+плата|доход)\\s*[:\\-]?\\s*\\d+[\\d\\s]*\\s?(руб|₽|рублей?|долларов?|\\$|евро|€)'),
    ('financial_amount', 'regex', 1, '\\b\\d+[\\d\\s]*[,.]?\\d*\\s?(руб|₽|рублей?|долларов?|\\$|евро|€)\\b'),
    ('health_info', 'regex', 1, '\\b(диагноз|болезнь|заболевание|лечение|медицин|больниц|поликлиник|врач|доктор)\\b'),
    ('beliefs', 'regex', 1, '\\b(религ|веро|полит|убежден|мировоззрен|партии)\\b'),
    ('login_credential', 'regex', 1, '\\b(логин|пароль|учетн[ая]\\s+запись|авторизац|аутентиф)\\b'),
    ('system_name', 'regex', 1, '\\b(система|подсистема|сервис|платформа)\\s+[А-ЯЁа-яё\\-\\d]+'),
    ('trade_secret', 'regex', 1, '\\b(конфиденциальн|коммерческ[ая]\\s+тайн|ноу-хау|секретн)\\b'),
    ('contract_number', 'regex', 1, '(?i)\\b(государственн(?:ый|ого|ому|ым|ом)\\s+контракт[ауе]?|договор[ауе]?|контракт[ауе]?)\\s+от\\s+\\d{1,2}\\s+[а-яё]+\\s+\\d{4}\\s+г\\.\\s+№\\s+[\\dА-ЯЁа-яё\\-\\/]+'),
    ('contract_number', 'regex', 1, '(?i)\\b(государственн(?:ый|ого|ому|ым|ом)\\s+контракт[ауе]?|договор[ауе]?|контракт[ауе]?)\\s+№\\s+[\\dА-ЯЁа-яё\\-\\/]+\\s+от\\s+\\d{1,2}\\.\\d{2}\\.\\d{4}'),
    ('contract_info', 'regex', 2, '\\b(договор|контракт|соглашение)\\s+№?\\s*[\\dА-ЯЁа-яё\\-\\/]+'),
    ('location', 'spacy_ner', 1, ''),
    ('address', 'regex', 1, '\\d{6},?\\s+[А-ЯЁа-яё]+\\s+(край|область|республика|город),?\\s+[гп]\\.[\\s]?[А-ЯЁа-яё]+,?\\s+ул\\.[\\s]?[А-ЯЁа-яё]+,?\\s+д\\.[\\s]?\\d+'),
    ('address', 'regex', 1, '[гп]\\.[\\s]?[А-ЯЁа-яё]+,?\\s+ул\\.[\\s]?[А-ЯЁа-яё]+,?\\s+д\\.[\\s]?\\d+'),
    ('address', 'regex', 1, 'ул\\.[\\s]?[А-ЯЁа-яё]+,?\\s+д\\.[\\s]?\\d+'),
    ('address_context', 'regex', 1, '\\b(адрес|проживает?|находится|расположен)\\s+[А-ЯЁа-яё\\s\\d,.-]+'),
    ('information_system', 'regex', 1, '\\b(ЕИС)([А-ЯA-Z]{2,})\\b'),
    ('information_system', 'regex', 1, '\\b(АИС)([А-ЯA-Z]{2,})\\b'),
    ('information_system', 'regex', 1, '\\b(ГИС)([А-ЯA-Z]{2,})\\b'),
    ('information_system', 'regex', 1, '\\b(ЕГИС)([A-ZА-ЯЁ]{2,})\\b'),
    ('website_url', 'regex', 1, "(?<![\\w./-])https?://[\\w.-]+(?:\\.[\\w.-]+)+[/\\w\\-.~:?#\\[\\]@!$&'()*+,;=]*"),
    ('information_system', 'regex', 1, '\\b(ПГИС)([А-ЯA-Z]{2,})\\b'),
    ('information_system', 'regex', 1, '\\b(ГАС)([А-ЯA-Z]{2,})\\b'),
    ('information_system', 'regex', 1, '\\b(ФИС)([А-ЯA-Z]{2,})\\b'),
    ('information_system', 'phrase', 2, 'ГИС ЖКХ'),
)

# For each category that is searched, its methods in order of priority with their least confidences, and its strategy.
CATEGORIES = {
    "person_name": ((("spacy_ner", 0.8), ("regex", 0.6), ("morphological", 0.7), ("custom_matcher", 0.9)), "best_confidence"),
    "organization": ((("spacy_ner", 0.8), ("phrase_matcher", 0.7), ("regex", 0.75)), "combine_all"),
    "position": ((("phrase_matcher", 0.8), ("regex", 0.7)), "first_match"),
    "address": ((("regex", 0.8), ("spacy_ner", 0.75)), "combine_all"),
    "government_org": ((("phrase_matcher", 0.8), ("spacy_ner", 0.65), ("regex", 0.8)), "hybrid_government"),
    "information_system": ((("spacy_ner", 0.7),), "information_system"),
    "contract_number": ((("regex", 0.8), ("context_matcher", 0.75)), "contract_number"),
    "financial_amount": ((("regex", 0.85), ("context_matcher", 0.75)), "best_confidence"),
    "website_url": ((("regex", 0.7),), "combine_all"),
}
# Confidences at which no further method of a category is used; 0.95 where not named.
EARLY_EXIT = {("person_name", "spacy_ner"): 0.95, ("person_name", "regex"): 0.9, ("organization", "spacy_ner"): 0.9}
# Words of which one must stand near a match of the category.
CONTEXT_WORDS = {
    "salary": ("зарплата", "оклад", "доход", "заработок", "выплата"),
    "health_info": ("диагноз", "лечение", "болезнь", "медицин", "больниц"),
    "contract_info": ("номер", "договор", "контракт", "соглашение"),
    "financial_amount": ("стоимость", "цена", "сумма", "оплата", "платеж"),
}
# Categories whose patterns mind case.
CASE_SENSITIVE = ("person_name", "information_system")
# The least confidence of any detection, characters of context, and detections of a category in a block at most.
LEAST_CONFIDENCE, CONTEXT_WIDTH, MOST_OF_CATEGORY = 0.6, 50, 2000
# Weights of methods in weighted averages.
METHOD_WEIGHTS = {"spacy_ner": 1.0, "morphological": 0.8, "regex": 0.6, "phrase_matcher": 0.7, "custom_matcher": 0.9}
# Words that show a government body, and forms of companies.
GOVERNMENT_WORDS = (
    "министерство", "департамент", "управление", "служба", "комитет", "администрация", "правительство", "дума", "совет", "федеральный",
    "государственный", "муниципальный", "краевой", "областной", "региональный",
)
COMMERCIAL_FORMS = ("ооо", "ао", "пао", "зао", "ип", "ltd", "inc")
