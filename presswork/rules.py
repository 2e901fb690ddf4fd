"""Rule tables and word lists.

Everything in this module is data, not logic: the operators in
``presswork.operators`` compile these tables into Catalyst expressions
(``CASE``/``contains`` chains) or small broadcast dimension frames.
Callers may pass their own tables of the same shape to any operator.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the original tool's tables for identical
# results. Kept verbatim, in their original order (order is semantics:
# the first matching category rule wins).
# ---------------------------------------------------------------------------

# Live rule set ("A"): category rules tested against the lower-cased title.
CATEGORY_RULES_A: list[tuple[str, list[str]]] = [
    ("ransomware", ["ransomware", "encrypt", "extortion", "locker"]),
    ("vulnerabilidades", ["cve-", "vulnerability", "zero-day", "0-day", "patch", "rce", "xss", "sqli", "csrf"]),
    ("apt", ["apt", "state-sponsored", "nation-state", "espionage"]),
    ("leaks/breaches", ["breach", "leak", "data stolen", "exposed", "compromised", "stolen data"]),
    ("cloud", ["aws", "azure", "gcp", "kubernetes", "docker", "cloud", "iam", "s3", "blob"]),
    ("phishing", ["phishing", "vishing", "smishing", "credential harvesting"]),
    ("malware", ["malware", "trojan", "botnet", "loader", "backdoor", "rat"]),
    ("ics/ot", ["ics", "scada", "ot", "plc"]),
]

# Live severity weights: every keyword *present* adds its weight once.
SEVERITY_HIGH_A: list[str] = [
    "zero-day", "0-day", "rce", "remote code execution", "worm", "critical", "actively exploited",
    "exploited in the wild", "cve-", "unauthenticated", "privilege escalation", "supply chain",
    "ransomware", "data leak", "breach", "mass exploitation",
]
SEVERITY_MED_A: list[str] = [
    "vulnerability", "patch", "phishing", "malware", "botnet", "ddos", "credential", "token",
    "backdoor", "loader", "exploit", "poc",
]
SEVERITY_HIGH_WEIGHT = 3
SEVERITY_MED_WEIGHT = 1
# score >= 5 -> alta, score >= 2 -> media, else baja
SEVERITY_THRESHOLDS_A: list[tuple[int, str]] = [(5, "alta"), (2, "media")]
SEVERITY_FLOOR = "baja"

SOC_ACTIONS_A: dict[str, str] = {
    "ransomware": "Revisar EDR por comportamiento de cifrado, verificar backups/restore, buscar notas/extorsión, y cazar IoCs (hashes, dominios, IPs).",
    "vulnerabilidades": "Priorizar patch/mitigación, revisar exposición (inventario/scan), buscar intentos de exploit en WAF/IDS y logs de autenticación.",
    "apt": "Hunting orientado a TTPs (MITRE), revisar endpoints críticos, credenciales, persistencia, y tráfico C2; activar detecciones temporales.",
    "leaks/breaches": "Validar alcance, revisar accesos anómalos, rotar credenciales/tokens, revisar logs de exfil y notificación interna.",
    "cloud": "Auditar IAM, accesos públicos, cambios de policy, claves/tokens, y logs (CloudTrail/AzureActivity); aplicar hardening rápido.",
    "phishing": "Buscar campañas en gateway/email, bloquear dominios/URLs, revisar endpoints que hicieron click, forzar reset MFA si aplica.",
    "malware": "Aislar host si hay indicios, extraer IoCs, revisar persistencia (run keys, services), y desplegar reglas YARA/EDR.",
    "ics/ot": "Revisar segmentación, accesos remotos/VPN, cambios en controladores, y alertas de integridad; coordinar con OT.",
}
SOC_ACTION_DEFAULT_A = "Revisar logs/telemetría relevante, extraer IoCs, validar exposición y aplicar mitigaciones."
SOC_SUFFIX_A: dict[str, str] = {
    "alta": " (ALTA) Elevar prioridad, abrir investigación y activar monitorización reforzada.",
    "media": " (MEDIA) Revisar en el día y ajustar detecciones.",
}
SOC_SUFFIX_DEFAULT_A = " (BAJA) Monitorizar y registrar."

# Second rule set ("B"): tested against "title summary".
CATEGORY_RULES_B: list[tuple[str, list[str]]] = [
    ("ransomware", ["ransomware", "lockbit", "encrypt", "extortion", "double extortion"]),
    ("vulnerabilidades", ["cve-", "zero-day", "0day", "rce", "sql injection", "xss", "patch", "cvss"]),
    ("apt", ["apt", "nation-state", "espionage", "intrusion set", "campaign"]),
    ("leaks/breaches", ["breach", "leak", "exposed", "data theft", "records", "stolen data"]),
    ("cloud", ["aws", "azure", "gcp", "kubernetes", "docker", "iam", "cloudtrail", "tenant"]),
    ("malware", ["stealer", "trojan", "botnet", "rat", "loader", "worm"]),
]
# First tier (in this order) with any keyword present wins, else "baja".
SEVERITY_TIERS_B: list[tuple[str, list[str]]] = [
    ("alta", ["critical", "actively exploited", "kev", "zero-day", "pre-auth rce", "rce", "cvss 9", "cvss 10"]),
    ("media", ["high", "exploited", "patch", "malware", "phishing", "botnet"]),
    ("baja", ["update", "guide", "report", "analysis", "research", "insights"]),
]
SOC_ACTIONS_B: dict[str, str] = {
    "vulnerabilidades": "Priorizar patch/mitigación, revisar exposición (inventario/scan), y buscar intentos de exploit en logs/WAF/IDS.",
    "ransomware": "Revisar EDR por comportamiento de cifrado, verificar backups/restore, y cazar IoCs (hashes, dominios, IPs).",
    "apt": "Hunting por TTPs (MITRE), revisar endpoints críticos, persistencia y tráfico C2; elevar monitorización temporal.",
    "leaks/breaches": "Validar alcance, revisar accesos anómalos, rotar credenciales/tokens y buscar indicios de exfiltración.",
    "cloud": "Auditar IAM, accesos públicos, cambios de policy y logs (CloudTrail/AzureActivity); aplicar hardening rápido.",
    "malware": "Aislar host si hay indicios, extraer IoCs, revisar persistencia (run keys/services) y desplegar reglas YARA/EDR.",
}
SOC_ACTION_DEFAULT_B = "Revisar telemetría, extraer IoCs si existen, validar exposición y aplicar mitigaciones razonables."

# Markdown guidance: two lines chosen by severity only.
MD_GUIDANCE: list[tuple[list[str], str, str]] = [
    (["alta", "crítica", "critica"],
     "Priorizar patch/mitigación, revisar exposición (inventario/scan), buscar intentos de exploit en WAF/IDS y logs de autenticación.",
     "(ALTA) Elevar prioridad, abrir investigación y activar monitorización reforzada."),
    (["media"],
     "Validar alcance, revisar actividad anómala, extraer IoCs y ajustar detecciones/alertas.",
     "(MEDIA) Revisar en el día y ajustar detecciones."),
]
MD_GUIDANCE_DEFAULT = (
    "Revisar logs/telemetría relevante, extraer IoCs, validar exposición y aplicar mitigaciones.",
    "(BAJA) Monitorizar y registrar.",
)

# Severity label -> rank (case-insensitive); anything else ranks 0.
SEVERITY_RANK: dict[str, int] = {"critica": 4, "crítica": 4, "alta": 3, "media": 2, "baja": 1}

# Stop words of the three trend variants.
STOPWORDS_MD: list[str] = [
    "with", "this", "that", "from", "have", "will", "their", "they", "into",
    "over", "more", "after", "than", "your", "what", "when", "been", "using",
    "says", "said", "report", "reports", "today",
]
STOPWORDS_REPORT: list[str] = [
    "with", "this", "that", "from", "have", "will", "their", "they", "into",
    "over", "more", "after", "than", "your", "what", "when", "been", "using",
    "says", "said", "report", "reports", "today",
    "para", "como", "esta", "este", "sobre", "entre", "pero", "porque",
]
STOPWORDS_REGEX: list[str] = [
    "this", "that", "with", "from", "have", "your", "about", "into", "after", "over", "their", "they", "them",
    "the", "and", "for", "are", "was", "were", "has", "had", "you", "its", "in", "on", "to", "of", "a", "an",
    "para", "como", "esta", "este", "sobre", "entre", "pero", "porque", "cuando", "donde",
]
# Characters stripped from both ends of a whitespace token.
TOKEN_STRIP_CHARS = ".,:;()[]{}'\"!?"
# Letters of the word pattern used by the summariser and the regex trends.
WORD_CLASS = "[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9\\-]"

# Query keys dropped by URL canonicalisation (case-sensitive).
TRACKING_PARAMS: list[str] = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "mc_cid", "mc_eid",
]

# Default configured sources: kind, name, url (link_tag for HTML pages).
DEFAULT_SOURCES: list[tuple[str, str, str]] = [
    ("rss", "TheHackerNews", "https://feeds.feedburner.com/TheHackersNews"),
    ("rss", "BleepingComputer", "https://www.bleepingcomputer.com/feed/"),
    ("rss", "KrebsOnSecurity", "https://krebsonsecurity.com/feed/"),
    ("rss", "CISAAdvisories", "https://www.cisa.gov/cybersecurity-advisories/all.xml"),
    ("rss", "SANS_ISC_Full", "https://isc.sans.edu/rssfeed_full.xml"),
    ("rss", "Schneier", "https://www.schneier.com/feed/atom/"),
    ("rss", "Securelist", "https://securelist.com/feed/"),
    ("rss", "Sophos_SecOps", "https://news.sophos.com/en-us/category/security-operations/feed/"),
    ("rss", "Threatpost", "https://threatpost.com/feed/"),
]

# Report defaults.
DEFAULT_SINCE = "24h"
DEFAULT_LIMIT = 25
LIMIT_MIN, LIMIT_MAX = 1, 200
TOP_N = 5
TREND_N = 10
SUMMARY_LINES = 5
TITLE_MAX, CONTENT_MAX, MD_SUMMARY_MAX, CLAMP_FALLBACK_MAX = 400, 8000, 600, 500
# --------------------------------------------------------------------------- end of fixed values
