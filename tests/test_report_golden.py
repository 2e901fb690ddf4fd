"""The Markdown report rebuilt from a three-article store must match the expected text exactly."""

import datetime as dt

from presswork.plans.daily import daily_report
from presswork.sources.store import ARTICLE_SCHEMA

HN = "https://thehackernews.com/2026/02/microsoft-discloses-dns-based-clickfix.html"
BC1 = "https://www.bleepingcomputer.com/news/security/ctm360-lumma-stealer-and-ninja-browser-malware-campaign-abusing-google-groups/"
BC2 = "https://www.bleepingcomputer.com/news/security/pastebin-comments-push-clickfix-javascript-attack-to-hijack-crypto-swaps/"
S1 = ("Microsoft has disclosed details of a new version of the ClickFix social engineering tactic in which the attackers "
      "trick unsuspecting users into running commands that carry out a Domain Name System (DNS) lookup to retrieve the "
      "next-stage payload. Specifically, the attack relies on using the \"nslookup\" (short for nameserver lookup) command "
      "to execute a custom DNS lookup triggered via the Windows")
S2 = ("CTM360 reports 4,000+ malicious Google Groups and 3,500+ Google-hosted URLs used to spread the Lumma Stealer "
      "infostealing malware and a trojanized \"Ninja Browser.\" The report details how attackers abuse trusted Google "
      "services to steal credentials and maintain persistence across Windows and Linux systems.")
S3 = ("Threat actors are abusing Pastebin comments to distribute a new ClickFix-style attack that tricks cryptocurrency "
      "users into executing malicious JavaScript in their browser, allowing attackers to hijack Bitcoin swap transactions "
      "and redirect funds to attacker-controlled wallets.")

ROWS = [
    (1, "TheHackerNews", "thehackernews.com",
     "Microsoft Discloses DNS-Based ClickFix Attack Using Nslookup for Malware Staging", HN, None,
     dt.datetime(2026, 2, 15, 19, 40), None, S1, "malware", "baja", None, "k1"),
    (2, "BleepingComputer", "www.bleepingcomputer.com",
     "CTM360: Lumma Stealer and Ninja Browser malware campaign abusing Google Groups", BC1, None,
     dt.datetime(2026, 2, 15, 11, 30, 41), None, S2, "malware", "media", None, "k2"),
    (3, "BleepingComputer", "www.bleepingcomputer.com",
     "Pastebin comments push ClickFix JavaScript attack to hijack crypto swaps", BC2, None,
     dt.datetime(2026, 2, 15, 10, 17, 27), None, S3, "general", "baja", None, "k3"),
]

G_BAJA = ["Revisar logs/telemetría relevante, extraer IoCs, validar exposición y aplicar mitigaciones.",
          "(BAJA) Monitorizar y registrar."]
G_MEDIA = ["Validar alcance, revisar actividad anómala, extraer IoCs y ajustar detecciones/alertas.",
           "(MEDIA) Revisar en el día y ajustar detecciones."]


def _detail(title, source, domain, pub, cat, sev, url, summ, guidance):
    return [f"### {title}", f"- Fuente: **{source}** | Dominio: `{domain}`", f"- Publicado: **{pub}**",
            f"- Categoría: **{cat}** | Severidad: **{sev}**", f"- URL: {url}", "**Resumen (3–5 líneas):**", summ,
            "**Qué debería mirar un SOC:**", *guidance]


EXPECTED = "\n".join([
    "# Informe diario de ciberseguridad — 2026-02-15",
    "Ventana analizada: últimas **24h**",
    "Noticias incluidas en reporte: **3** (limit=25)",
    "",
    "## Top 5 del día",
    f"1. **{ROWS[1][3]}** ", " - Severidad: **media** | Categoría: **malware** ", f" - URL: {BC1}",
    f"2. **{ROWS[0][3]}** ", " - Severidad: **baja** | Categoría: **malware** ", f" - URL: {HN}",
    f"3. **{ROWS[2][3]}** ", " - Severidad: **baja** | Categoría: **general** ", f" - URL: {BC2}",
    "",
    "## Tendencias (términos repetidos)",
    "`clickfix`(2), `attack`(2), `malware`(2), `microsoft`(1), `discloses`(1), `dns-based`(1), `nslookup`(1), "
    "`staging`(1), `ctm360`(1), `lumma`(1)",
    "",
    "## Detalle por noticia",
    *_detail(ROWS[0][3], "TheHackerNews", "thehackernews.com", "2026-02-15T19:40:00", "malware", "baja", HN, S1, G_BAJA),
    "",
    *_detail(ROWS[1][3], "BleepingComputer", "www.bleepingcomputer.com", "2026-02-15T11:30:41", "malware", "media", BC1,
             S2, G_MEDIA),
    "",
    *_detail(ROWS[2][3], "BleepingComputer", "www.bleepingcomputer.com", "2026-02-15T10:17:27", "general", "baja", BC2,
             S3, G_BAJA),
]) + "\n"


def test_golden_report(spark):
    store = spark.createDataFrame(ROWS, ARTICLE_SCHEMA)
    rep = daily_report(store, dt.datetime(2026, 2, 15, 20, 0), "24h", 25, enrich_rows=False, summarize=True)
    assert rep.markdown() == EXPECTED


def test_golden_top5_and_counts(spark):
    store = spark.createDataFrame(ROWS, ARTICLE_SCHEMA)
    rep = daily_report(store, dt.datetime(2026, 2, 15, 20, 0), "24h", 25, enrich_rows=False)
    assert [r.arrival_id for r in rep.top.orderBy("rank").collect()] == [2, 1, 3]
    c = rep.counts.collect()[0]
    assert (c.critica, c.alta, c.media, c.baja) == (0, 0, 1, 2)


def test_window_excludes_old_rows(spark):
    rows = ROWS + [(4, "X", "x.org", "Old item", "https://x.org/old", None, dt.datetime(2026, 2, 13), None, "s",
                    None, None, None, "k4")]
    store = spark.createDataFrame(rows, ARTICLE_SCHEMA)
    rep = daily_report(store, dt.datetime(2026, 2, 15, 20, 0), "24h", 25, enrich_rows=False)
    assert rep.markdown() == EXPECTED


def test_empty_window_report(spark):
    old = [(9, "X", "x.org", "Old item", "https://x.org/old", None, dt.datetime(2026, 1, 1), None, "s", None, None, None, "k")]
    rep = daily_report(spark.createDataFrame(old, ARTICLE_SCHEMA), dt.datetime(2026, 2, 15, 20, 0), "24h", 25)
    assert rep.markdown() == "\n".join([
        "# Informe diario de ciberseguridad — 2026-02-15",
        "Ventana analizada: últimas **24h**",
        "Noticias incluidas en reporte: **0** (limit=25)",
        "",
        "## Top 5 del día",
        "",
        "## Tendencias (términos repetidos)",
        "(sin datos)",
        "",
        "## Detalle por noticia",
    ]) + "\n"
