"""The structured rules that come with the engine: category, pattern, description, confidence."""

# Patterns and confidences that decide what is found.
RULES = (
    ('phone', r"\b\+?7[-\s]?\(?9\d{2}\)?[-\s]?\d{3}[-\s]?\d{2}[-\s]?\d{2}\b", 'Российский мобильный номер (+7-9XX-XXX-XX-XX)', 0.95),
    ('phone', r"\b\+?7[-\s]?\(?\d{3}\)?[-\s]?\d{3}[-\s]?\d{2}[-\s]?\d{2}\b", 'Российский телефонный номер (+7-XXX-XXX-XX-XX)', 0.9),
    ('phone', r"\b8[-\s]?\(?9\d{2}\)?[-\s]?\d{3}[-\s]?\d{2}[-\s]?\d{2}\b", 'Российский мобильный номер (8-9XX-XXX-XX-XX)', 0.9),
    ('phone', r"\b8[-\s]?\(?\d{3}\)?[-\s]?\d{3}[-\s]?\d{2}[-\s]?\d{2}\b", 'Российский городской номер (8-XXX-XXX-XX-XX)', 0.85),
    ('email', r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2}\b", 'Email адрес', 0.98),
    ('passport', r"\b\d{4}[-\s]?\d{6}\b", 'Серия и номер паспорта РФ (XXXX XXXXXX)', 0.85),
    ('passport', r"\b\d{2}[-\s]?\d{2}[-\s]?\d{6}\b", 'Паспорт РФ с разделителями (XX XX XXXXXX)', 0.8),
    ('inn', r"\b\d{10}\b", 'ИНН физического лица (10 цифр)', 0.7),
    ('inn', r"\b\d{12}\b", 'ИНН юридического лица (12 цифр)', 0.7),
    ('snils', r"\b\d{3}[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{2}\b", 'СНИЛС (XXX-XXX-XXX XX)', 0.9),
    ('name', r"\b[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+)?\b", 'ФИО на русском языке', 0.6),
    ('name', r"\b[A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b", 'ФИО на английском языке', 0.55),
    ('bank_account', r"\b\d{20}\b", 'Банковский счет (20 цифр)', 0.8),
    ('bank_account', r"\b\d{5}[-\s]?\d{3}[-\s]?\d{1}[-\s]?\d{4}[-\s]?\d{7}\b", 'Банковский счет с разделителями', 0.85),
    ('card_number', r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", 'Номер банковской карты (16 цифр)', 0.9),
    ('card_number', r"\b\d{4}[-\s]?\d{6}[-\s]?\d{5}\b", 'Номер банковской карты American Express (15 цифр)', 0.88),
    ('ogrn', r"\b\d{13}\b", 'ОГРН организации (13 цифр)', 0.75),
    ('ogrn', r"\b\d{1}[-\s]?\d{2}[-\s]?\d{2}[-\s]?\d{2}[-\s]?\d{6}\b", 'ОГРН с разделителями', 0.8),
    ('ogrnip', r"\b\d{15}\b", 'ОГРНИП индивидуального предпринимателя (15 цифр)', 0.75),
    ('kpp', r"\b\d{9}\b", 'КПП организации (9 цифр)', 0.7),
    ('kpp', r"\b\d{4}[-\s]?\d{2}[-\s]?\d{3}\b", 'КПП с разделителями (XXXX-XX-XXX)', 0.75),
    ('bik', r"\b04\d{7}\b", 'БИК банка России (начинается с 04)', 0.85),
    ('date_birth', r"\b\d{2}\.\d{2}\.\d{4}\b", 'Дата рождения (ДД.ММ.ГГГГ)', 0.6),
    ('date_birth', r"\b\d{2}/\d{2}/\d{4}\b", 'Дата рождения (ДД/ММ/ГГГГ)', 0.6),
    ('date_birth', r"\b\d{1,2}[-\s]\w+[-\s]\d{4}\b", 'Дата рождения (ДД месяц ГГГГ)', 0.65),
    ('date_birth', r"\b(?:0?[1-9]|[12]\d|3[01])\.(?:0?[1-9]|1[0-2])\.(?:19|20)\d{2}\b", 'Валидная дата рождения (ДД.ММ.ГГГГ)', 0.75),
    ('driver_license', r"\b\d{2}\s\d{2}\s\d{6}\b", 'Водительское удостоверение РФ (XX XX XXXXXX)', 0.8),
    ('driver_license', r"\b\d{4}\s\d{6}\b", 'Водительское удостоверение РФ (XXXX XXXXXX)', 0.75),
    ('address', r"\b(?:г\.?\s*)?[А-ЯЁ][а-яё]+(?:\s*-\s*[А-ЯЁ][а-яё]+)?\b", 'Город в адресе', 0.5),
    ('address', r"\b(?:ул\.?\s*|улица\s+)[А-ЯЁ][а-яё\s\-]+", 'Улица в адресе', 0.6),
    ('address', r"\b(?:пр\.?\s*|проспект\s+)[А-ЯЁ][а-яё\s\-]+", 'Проспект в адресе', 0.6),
    ('address', r"\bд\.?\s*\d+(?:[а-я])?(?:\s*корп\.?\s*\d+)?(?:\s*кв\.?\s*\d+)?\b", 'Номер дома/квартиры', 0.4),
    ('address', r"\b\d{6}\b", 'Почтовый индекс', 0.5),
    ('foreign_passport', r"\b\d{2}\s\d{7}\b", 'Заграничный паспорт РФ', 0.75),
    ('military_id', r"\b[А-Я]{2}\s\d{7}\b", 'Военный билет', 0.7),
    ('insurance_policy', r"\b\d{16}\b", 'Полис медицинского страхования (16 цифр)', 0.65),
    ('car_number', r"\b[А-Я]\d{3}[А-Я]{2}\d{2,3}\b", 'Автомобильный номер РФ', 0.8),
    ('coordinates', r"\b\d{1,3}\.\d+°?\s*[NS],?\s*\d{1,3}\.\d+°?\s*[EW]\b", 'GPS координаты', 0.7),
    ('medical', r"\b(?:группа крови|гр\.?\s*кр\.?)\s*[ABОАВ]{1,2}[IVХ]{1,3}[+-]?\b", 'Группа крови', 0.8),
)
