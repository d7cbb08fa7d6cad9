"""Fixed values that must equal the original application's for equal results.

Everything in this module is data, not logic: word lists, thresholds, labels and
patterns, written out plainly in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: ingestion
# ---------------------------------------------------------------------------
SUPPORTED_SUFFIXES: tuple[str, ...] = (".csv", ".xlsx", ".xls")
KNOWN_REGIONS: dict[str, str] = {
    "nord": "Nord",
    "sud": "Sud",
    "est": "Est",
    "ouest": "Ouest",
    "centre": "Centre",
    "central": "Centre",
    "littoral": "Littoral",
}
# Null tokens: pandas' default NA strings plus the extra ones passed by the reader.
NA_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
CSV_DELIMITERS: tuple[str, ...] = (",", ";", "|", "\t")
EMPTY_FILE_REASON = "fichier vide ignore."
UNSUPPORTED_REASON = "format non supporte (CSV, XLSX, XLS uniquement)."
PARSE_ERROR_REASON = "Error tokenizing data (ligne avec trop de champs)."
DECODE_ERROR_REASON = "fichier illisible (encodage non UTF-8)."
REJECTED_ROWS_REASON = "%d ligne(s) rejetee(s): %s"
NO_COLUMNS_REASON = "No columns to parse from file"
LEGACY_REASON = "format .xls non pris en charge (convertir en .xlsx)."
NO_FILE_ERROR = "Aucun fichier recu pour la consolidation."
NO_VALID_FILE_ERROR = "Aucun fichier valide n'a pu etre consolide."
MISSING_FOLDER_ERROR = "Le dossier {folder} est introuvable."
# FIXED VALUES: currency words and signs that a strict amount may carry.
CURRENCIES: tuple[str, ...] = ("EUR", "USD", "XAF", "XOF", "FCFA", "GBP", "CHF", "€", "$", "£")
# FIXED VALUES: texts of the batch job.
JOB_DESCRIPTION = "Consolider, nettoyer et exporter des rapports financiers."
WARNINGS_TITLE = "Avertissements:"
JOB_DONE = "Consolidation terminee. Fichiers generes dans: {folder}"
EMPTY_LEDGER_ERROR = "La consolidation est vide, impossible de nettoyer les donnees."
EMPTY_FOLDER_ERROR = "Aucun fichier CSV/XLSX trouve dans {folder}."

# ---------------------------------------------------------------------------
# FIXED VALUES: column roles (aliases and keywords, in the original order)
# ---------------------------------------------------------------------------
AMOUNT_ALIASES: tuple[str, ...] = (
    "montant", "montant_engagement", "montant_total", "montant_net", "montant_brut",
    "engagement", "engagement_amount", "amount", "amount_total", "valeur", "value",
    "encours", "solde", "principal", "capital", "revenu", "revenue", "chiffre_affaires",
)
PME_ALIASES: tuple[str, ...] = (
    "pme", "nom_pme", "nom_entreprise", "entreprise", "societe", "beneficiaire",
    "beneficiaire_final", "client", "raison_sociale", "contrepartie", "counterparty", "tiers",
)
DATE_ALIASES: tuple[str, ...] = (
    "date", "date_engagement", "date_operation", "date_transaction", "date_valeur",
    "date_comptable", "engagement_date", "periode", "periode_comptable", "timestamp",
    "month", "mois",
)
FLOW_ALIASES: tuple[str, ...] = (
    "flux", "type_flux", "nature_flux", "categorie_flux", "flow", "flow_type",
    "type_operation", "nature_operation", "operation", "mouvement", "sens", "transaction_type",
)
AMOUNT_KEYWORDS: tuple[str, ...] = (
    "montant", "engagement", "amount", "valeur", "value", "encours", "solde", "capital",
    "principal", "revenu", "revenue", "chiffre", "affaires",
)
PME_KEYWORDS: tuple[str, ...] = (
    "pme", "entreprise", "societe", "beneficiaire", "client", "raison", "sociale",
    "contrepartie", "tiers",
)
DATE_KEYWORDS: tuple[str, ...] = (
    "date", "periode", "mois", "month", "timestamp", "valeur", "transaction", "comptable",
    "operation",
)
FLOW_KEYWORDS: tuple[str, ...] = (
    "flux", "flow", "type", "nature", "categorie", "operation", "mouvement", "sens",
    "transaction",
)
FLOW_VALUE_HINTS: tuple[str, ...] = (
    "inflow", "outflow", "credit", "debit", "entree", "sortie", "paiement", "achat",
    "vente", "payment",
)
# Name tokens that adjust content scores.
AMOUNT_PENALTY_TOKENS: tuple[str, ...] = ("id", "code", "numero", "num", "phone", "telephone")
DATE_BONUS_TOKENS: tuple[str, ...] = ("date", "periode", "timestamp", "month", "mois")
FLOW_BONUS_TOKENS: tuple[str, ...] = ("flux", "flow", "nature", "operation", "mouvement", "sens")
PME_BONUS_TOKENS: tuple[str, ...] = ("pme", "entreprise", "societe", "client", "beneficiaire")
PME_PENALTY_TOKENS: tuple[str, ...] = ("region", "flux", "flow", "date", "montant", "amount")

INTERNAL_COLUMNS: tuple[str, ...] = ("source_file",)
AMOUNT_SCORE_THRESHOLD = 8.0
DATE_SCORE_THRESHOLD = 8.0
FLOW_SCORE_THRESHOLD = 5.5
PME_SCORE_THRESHOLD = 5.5
NAME_SCORE_THRESHOLD = 18
NAME_ACCEPT_SCORE = 40
CLEAR_LEAD = 0.75
RATIO_THRESHOLD = 0.75

# ---------------------------------------------------------------------------
# FIXED VALUES: defaults written by the cleaning step
# ---------------------------------------------------------------------------
DEFAULT_FLOW = "Flux non classe"
DEFAULT_PME = "PME inconnue"
DEFAULT_REGION = "Inconnue"
DEFAULT_DIMENSION = "Non classe"
DEFAULT_DATE_COLUMN = "date_engagement"
DEFAULT_FLOW_COLUMN = "flux"
DEFAULT_PME_COLUMN = "pme"
EMPTY_SLUG = "colonne"

# ---------------------------------------------------------------------------
# FIXED VALUES: optional columns of the profiles (concept -> aliases, in order)
# ---------------------------------------------------------------------------
OPTIONAL_ALIASES: dict[str, tuple[str, ...]] = {
    "revenue": ("revenu", "revenues", "revenue", "chiffre_affaires", "ca"),
    "ebitda": ("ebitda",),
    "net_profit": ("profit_net", "net_profit", "benefice_net", "resultat_net"),
    "cash_flow": ("cash_flow", "flux_tresorerie", "flux_de_tresorerie"),
    "budget": ("budget", "budget_planifie", "planned_budget"),
    "cost": ("cout", "cost", "cout_production", "production_cost"),
    "product": ("produit", "product", "service", "segment", "categorie"),
    "equity": ("equity", "fonds_propres", "capitaux_propres"),
    "assets": ("assets", "actifs", "total_assets"),
    "debt": ("debt", "dette", "total_debt"),
    "investment": ("investment", "investissement"),
    "ar": ("accounts_receivable", "ar", "creances_clients"),
    "ap": ("accounts_payable", "ap", "dettes_fournisseurs"),
    "status": ("status", "statut", "invoice_status", "payment_status"),
    "default_flag": ("default", "defaut", "non_performing", "npl"),
    "volume": ("volume", "quantite"),
    "price": ("price", "prix", "cours"),
}

# ---------------------------------------------------------------------------
# FIXED VALUES: text patterns (lower-cased text is matched)
# ---------------------------------------------------------------------------
OUTFLOW_PATTERN = "debit|sortie|outflow|expense|depense|paiement|withdraw|achat"
CREDIT_RISK_PATTERN = "credit|loan|pret"
AML_PATTERN = "cash|crypto|offshore|sanction|aml"
LOAN_PATTERN = "loan|pret|credit"
PENDING_PATTERN = "pending|en_attente|late|retard"

# ---------------------------------------------------------------------------
# FIXED VALUES: metric constants
# ---------------------------------------------------------------------------
EBITDA_RATE = 0.27
NET_PROFIT_RATE = 0.14
COST_RATE = 0.65
BUDGET_UPLIFT = 1.08
AR_RATE = 0.35
AP_RATE = 0.30
EQUITY_RATE = 0.45
ASSETS_RATE = 1.4
DEBT_RATE = 0.5
INVESTMENT_RATE = 0.4
LIQUIDITY_BASE_RATE = 0.30
CASH_FORECAST_RATE = 0.9
SCENARIO_MULTIPLIERS: tuple[tuple[str, float], ...] = (
    ("Optimiste", 1.1),
    ("Central", 1.0),
    ("Pessimiste", 0.85),
)
# Profiles whose cards need the monthly table only, not the rows.
MONTHLY_PROFILES: tuple[str, ...] = ("F01", "F02", "F03", "F04", "F08", "F09", "F12")
FORECAST_HORIZON = 6
SIMULATION_PATHS = 500
SIMULATION_STD_FLOOR = 0.02
Z_SCORE_LIMIT = 3.0
STD_EPSILON = 1e-9
SAFE_RATIO_EPSILON = 1e-9
SHARPE_EPSILON = 1e-9
SHARPE_ANNUALISATION = 12.0
PENDING_QUANTILE = 0.9
FRAUD_QUANTILE = 0.99
VAR_QUANTILE = 0.05
STRESS_QUANTILE = 0.01
AGING_BUCKETS: tuple[tuple[int, str, int, int], ...] = (
    # ord, label, lower bound (exclusive), upper bound (inclusive); the last is open: its
    # bound is the largest day count there is
    (1, "0-30", -1, 30),
    (2, "31-60", 30, 60),
    (3, "61-90", 60, 90),
    (4, "90+", 90, 2147483647),
)
HISTOGRAM_BINS = 30
TOP_N_REPORT = 10
REPORT_LABEL_CHARS = 45
RUNWAY_STABLE_TEXT = "Stable (>12 mois)"
NO_DATA_TEXT = "Aucune donnee disponible."
