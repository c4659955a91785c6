"""Data literals and labels that results must carry exactly."""

# Channel tags.
ONLINE = "Shotgun"
DOOR = "Porta"

# Ticket status literals.
VALID = "valid"
CANCELED = "canceled"

# Labels.
FREE = "Gratuito"
PAID = "Pago"
DIRECT = "direto"
UNKNOWN_MEDIUM = "desconhecido"
OTHER_PAYMENT = "outro"
SUBSCRIBED = "Inscrito"
NOT_SUBSCRIBED = "Não Inscrito"
IGNORED_SHOW = "(ignorar)"

WEEKDAY_LABELS = ["Seg", "Ter", "Qua", "Qui", "Sex", "Sáb", "Dom"]

# Placeholders that mean "not given".
GENDER_PLACEHOLDERS = ["-", ""]
CITY_PLACEHOLDERS = ["-", "01008-000", ""]

# Chart ranges.
LEAD_TIME_LAST_BUCKET = 30
AGE_FIRST, AGE_LAST = 16, 80
TOP_CITIES = 15
TOP_BUYERS = 10

# Card-terminal statement.
STATEMENT_PREAMBLE_LINES = 8
STATEMENT_DATE, STATEMENT_TYPE, STATEMENT_AMOUNT = "Data", "Tipo", "Entradas"
STATEMENT_SALE = "Vendas"
STATEMENT_DATE_PATTERN = "d/M/yyyy"

# Allowed origins of a door-ledger entry.
ORIGIN_MANUAL = "manual"
ORIGIN_STATEMENT = "pagbank_csv"
ORIGIN_CONSOLIDATED = "consolidated_upload"
LEDGER_ORIGINS = [ORIGIN_MANUAL, ORIGIN_STATEMENT, ORIGIN_CONSOLIDATED]
