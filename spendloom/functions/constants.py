"""Fixed values that results must agree on."""

#: Words that stand for a missing value, compared trimmed and in lower case.
NULL_PROXIES = ["na", "#na", "n/a", "#n/a", "none", "null", "nan", "-", "unknown", "not applicable", "tbd", "misc", "miscellaneous", "other", "general", "unclassified", "."]
#: In description panels a lone zero counts as missing too.
DESCRIPTION_PROXIES = [*NULL_PROXIES, "0"]

NON_PROCURABLE = [
    "customs duties", "government fee", "license fee", "legal charges", "bank charges", "currency adjustment", "write-off", "taxes", "tax",
    "rebate", "duty", "freight", "shipping", "insurance", "penalty", "fine", "interest", "surcharge",
]

#: Legal forms and generic endings that a supplier's name loses, as regular expressions.
SUPPLIER_SUFFIXES = [
    r"Inc\.?", "Incorporated", r"Ltd\.?", "Limited", "LLC", r"L\.?L\.?C\.?", r"Corp\.?", "Corporation", r"Co\.?", "Company", "GmbH", "AG", "SA",
    r"S\.?A\.?", r"S\.?A\.?S\.?", r"S\.?R\.?L\.?", r"Pty\.?", "PLC", r"P\.?L\.?C\.?", "LLP", r"L\.?L\.?P\.?", "LP", "Holdings", "Holding",
    "International", r"Intl\.?", "Group", r"Grp\.?", "Enterprises?", "Solutions?", "Services?", "Technologies", "Technology", "Tech", "KG", "KGaA",
    "BV", r"B\.?V\.?", "NV", r"N\.?V\.?", "OY", "AB", "AS", "A/S", r"Pvt\.?", "Private",
]
WEB_DOMAINS = ["com", "net", "org", "io", "co", "biz", "info"]

#: Countries of each region; all other countries have none.
REGIONS = {
    "NA": ["United States", "Canada", "Puerto Rico"],
    "LATAM": ["Mexico", "Brazil", "Argentina", "Chile", "Colombia", "Peru", "Ecuador", "Venezuela", "Uruguay", "Paraguay", "Bolivia", "Costa Rica", "Panama", "Dominican Republic"],
    "EMEA": [
        "United Kingdom", "Germany", "France", "Italy", "Spain", "Netherlands", "Belgium", "Switzerland", "Austria", "Sweden", "Norway", "Denmark", "Finland", "Ireland",
        "Portugal", "Poland", "Czech Republic", "Romania", "Hungary", "Greece", "Turkey", "Russia", "Ukraine", "Luxembourg", "Slovakia", "Slovenia", "Croatia", "Bulgaria",
        "Serbia", "Lithuania", "Latvia", "Estonia", "Cyprus", "Malta", "Iceland", "South Africa", "Nigeria", "Egypt", "Kenya", "Ghana", "Tanzania", "Ethiopia", "Morocco",
        "Tunisia", "Algeria", "Saudi Arabia", "United Arab Emirates", "Israel", "Qatar", "Kuwait", "Bahrain", "Oman", "Jordan", "Lebanon",
    ],
    "APAC": [
        "Japan", "China", "India", "South Korea", "Australia", "New Zealand", "Singapore", "Malaysia", "Thailand", "Indonesia", "Philippines", "Vietnam", "Taiwan",
        "Hong Kong", "Pakistan", "Bangladesh", "Sri Lanka", "Myanmar", "Cambodia",
    ],
}

#: ISO codes of the countries most met in spend data; pass a fuller table where it is needed.
COUNTRY_CODES = {
    "US": "United States", "USA": "United States", "CA": "Canada", "CAN": "Canada", "MX": "Mexico", "MEX": "Mexico", "BR": "Brazil", "BRA": "Brazil",
    "GB": "United Kingdom", "GBR": "United Kingdom", "UK": "United Kingdom", "DE": "Germany", "DEU": "Germany", "FR": "France", "FRA": "France", "IT": "Italy", "ITA": "Italy",
    "ES": "Spain", "ESP": "Spain", "NL": "Netherlands", "NLD": "Netherlands", "CH": "Switzerland", "CHE": "Switzerland", "JP": "Japan", "JPN": "Japan", "CN": "China",
    "CHN": "China", "IN": "India", "IND": "India", "AU": "Australia", "AUS": "Australia", "SG": "Singapore", "SGP": "Singapore", "ZA": "South Africa", "ZAF": "South Africa",
}

#: Other spellings of countries.
COUNTRY_ALIASES = {
    "UNITED STATES OF AMERICA": "United States", "GREAT BRITAIN": "United Kingdom", "GERM": "Germany", "DEUTSCHLAND": "Germany", "PRC": "China", "BRASIL": "Brazil",
    "ITALIA": "Italy", "ESPANA": "Spain", "KOREA": "South Korea", "HOLLAND": "Netherlands", "SUISSE": "Switzerland", "CZECHIA": "Czech Republic", "TURKIYE": "Turkey",
    "KSA": "Saudi Arabia", "UAE": "United Arab Emirates",
}

#: Patterns of clock times behind a date, and of the one in an ISO timestamp.
CLOCK = r"(?i)\s+\d{1,2}:\d{2}(:\d{2})?(\s*(AM|PM))?$"
ISO_CLOCK = r"(?i)T\d{2}:\d{2}(:\d{2})?(\..*?)?(Z|[+-]\d{2}:\d{2})?$"

#: Signs that no supplier's name ends with, and patterns of what a plant's name loses at its end.
SUPPLIER_TAIL = " ,.-&/"
PLANT_NUMBER, PLANT_REMARK = r"[-_]\d{3,}$", r"\s*\(.*?\)\s*$"

#: Payment terms, without regard to case: patterns of payment at once with their discount text, of terms whose
#: first number is the days, and of a discount (percent, its days, the days); and words for none.
AT_ONCE = [(r"^(COD|C\.?O\.?D\.?)$", ""), (r"^(CIA|C\.?I\.?A\.?)$", "Cash in advance"), (r"^(Cash|Immediate|Sofort)$", ""), (r"^Due\s*on\s*Receipt$", "")]
DAYS_TERMS = [r"^Net[\s\-_]*(\d+)$", r"^N(\d+)$", r"^D(\d+)$", r"^(\d+)\s*Days?$", r"^(\d+)$"]
DISCOUNT_TERM = r"^(\d+)[%/](\d+)\s*(?:Net|N)[\s\-_]*(\d+)$"
NO_TERM = ["nan", "none", "null", ""]

#: How much a word in a header speaks for a currency or a spend column, and words of date headers.
CURRENCY_WORDS = {
    "currency code": 1.0, "currency_code": 1.0, "currency": 0.95, "curr code": 0.9, "curr_code": 0.9, "ccy code": 0.9, "ccy_code": 0.9, "curr": 0.85, "ccy": 0.85,
    "fx code": 0.7, "fx_code": 0.7, "iso code": 0.65, "iso_code": 0.65, "iso": 0.55, "fx": 0.5,
}
SPEND_WORDS = {"spend": 1.0, "amount": 0.9, "cost": 0.85, "price": 0.8, "payment": 0.75, "invoice": 0.75, "charge": 0.7, "fee": 0.65, "total": 0.6, "value": 0.55}
DATE_WORDS = ["date", "dob", "time"]

#: Countries whose name here differs from the one in the platform's own list.
COUNTRY_NAMES = {"CZ": "Czech Republic", "HK": "Hong Kong", "MM": "Myanmar", "TR": "Turkey"}

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
