"""URL filters: rules on host and path, then a weighted URL vocabulary matched by Aho-Corasick.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased;
the path goes on up to ``?``, ``#`` or the end. A url that is null or has no ``://`` has both empty.

A rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's; of the rules
that fit, the longest gives the verdict. Host, path and rule are built-in expressions.

Where no rule fits, the vocabulary judges the whole url, query and fragment included, also one without ``://``. It is a
table of terms with a category, a language and a kind. One strict term blocks, and so do ``SOFT`` different soft terms of one category. A term counts
only where no ASCII letter or digit stands right before or after it; a stem, a strict term that no other word contains, counts
inside the words of a host too (``bestcasino``). A pitch (cheap, online) right before or after a ware (pills, slots) is a strict term as well; such
terms are built from the two lists, joined directly, by a hyphen or by an underscore. One automaton finds all terms in one pass; a
vocabulary of more than ``MOST_TERMS`` is refused, as it is sent to every task.

Only the url is read; each row is judged by itself, so repeated rows and other columns need no care. Empty and very
long urls are judged whole. A table without rows gives none.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import prepare

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Different soft terms of a category that block.
SOFT = 2
MOST_TERMS = 1_000_000
#: (category, language, kind, terms); ``*`` for terms that all languages use. Topics that are news or schooling as often (virus, trojan, drugs) aren't here.
VOCABULARY = (
    ("adult", "*", "stem", "porn hentai camgirl sexcam sexchat blowjob gangbang bukkake creampie shemale xhamster xvideos redtube brazzers chaturbate livejasmin stripchat bongacams"),
    ("adult", "*", "strict", "xxx xnxx milf milfs nsfw pussy fuck fucking anal porno"),
    ("adult", "en", "soft", "adult adults amateur amateurs dating erotic erotica escort escorts fetish girls horny hookup lesbian mature naked nude nudes sex sexy strip strippers teen teens webcam webcams"),
    ("adult", "de", "soft", "erotik nackt huren nutten sexkontakte reife frauen amateure kontakte"),
    ("adult", "es", "soft", "desnuda desnudas erotico eroticas putas sexo chicas maduras"),
    ("adult", "fr", "soft", "erotique nue nues salope salopes sexe filles rencontre rencontres"),
    ("gambling", "*", "stem", "casino sportsbook gambling freespins pokerstars bet365 betfair unibet 1xbet betway sportingbet draftkings williamhill"),
    ("gambling", "*", "strict", "poker blackjack bwin bookie bookies bookmaker bookmakers"),
    ("gambling", "en", "soft", "bet bets betting jackpot jackpots lottery odds roulette slot slots wager wagers spins baccarat"),
    ("gambling", "de", "strict", "sportwetten spielautomaten spielbank"),
    ("gambling", "de", "soft", "wetten wette quoten lotto spielhalle gewinnspiel"),
    ("gambling", "es", "strict", "apuestas tragaperras"),
    ("gambling", "es", "soft", "ruleta loteria bingo cuotas"),
    ("gambling", "fr", "strict", "paris-sportifs machines-a-sous"),
    ("gambling", "fr", "soft", "loterie roulette pari paris cotes"),
    ("pharmacy", "*", "stem", "viagra levitra kamagra xanax tramadol sildenafil tadalafil"),
    ("pharmacy", "*", "strict", "cialis ambien valium oxycontin"),
    ("pharmacy", "en", "soft", "drugstore meds pharmacy pharmacies pill pills prescription prescriptions rx steroid steroids viagra-alternative"),
    ("pharmacy", "de", "strict", "potenzmittel rezeptfrei"),
    ("pharmacy", "es", "soft", "farmacia pastillas recetas sin-receta"),
    ("pharmacy", "fr", "soft", "pharmacie pilules sans-ordonnance"),
    ("piracy", "*", "stem", "keygen warez thepiratebay"),
    ("piracy", "en", "soft", "crack cracked cracks nulled serial serials torrent torrents activator"),
    ("spam", "en", "strict", "clickbait linkfarm replica-watches payday-loan payday-loans"),
    ("spam", "en", "soft", "replica replicas payday loans backlinks followers"),
)
#: Pitches, and by category the wares that they make strict terms with.
PITCHES = "best buy cheap discount easy fast free hot instant live online order real top win"
WARES = {
    "adult": "escorts nudes sex sexcams",
    "gambling": "bet bets betting bingo jackpot jackpots lottery roulette slot slots",
    "pharmacy": "drugs meds pharmacies pharmacy pill pills prescription prescriptions steroids",
    "piracy": "cracks serials torrents",
}
_FOLD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LOWER = str.maketrans(*_FOLD)


Term = tuple[str, str, str, str]


def vocabulary() -> list[Term]:
    """The built-in table: term, category, language, kind."""
    out = [(term, category, language, kind) for category, language, kind, terms in VOCABULARY for term in terms.split()]
    for category, wares in WARES.items():
        for pitch, ware, joint in itertools.product(PITCHES.split(), wares.split(), ("", "-", "_")):
            out += [(f"{pitch}{joint}{ware}", category, "en", "strict"), (f"{ware}{joint}{pitch}", category, "en", "strict")]
    return out


def kinds_of(terms: DataFrame | list[Term] | None) -> dict[str, list[tuple[str, str]]]:
    """The categories and kinds of each term."""
    if isinstance(terms, DataFrame):
        # one more row than allowed shows that there are too many; nothing is cut
        rows = [tuple(r) for r in terms.where("term <> ''").select("term", "category", "language", "kind").limit(MOST_TERMS + 1).collect()]
    else:
        rows = vocabulary() if terms is None else terms
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary of more than {MOST_TERMS} terms")
    out: dict[str, list[tuple[str, str]]] = {}
    for term, category, _, kind in rows:
        own = out.setdefault(term.translate(_LOWER), [])
        if (category, kind) not in own:
            own.append((category, kind))
    return out


def blocked(automaton: ahocorasick.Automaton, url: str, host: str, soft: int) -> bool:
    """One strict term, or ``soft`` different soft ones of a category, in a folded url with that host."""
    first = url.index("://") + 3 if host else 0
    met: dict[str, set[str]] = {}
    for end, (term, kinds) in automaton.iter(url):
        start = end + 1 - len(term)
        before, after = url[start - 1 : start], url[end + 1 : end + 2]
        whole = not (after.isascii() and after.isalnum() or before.isascii() and before.isalnum())
        in_host = host and first <= start and end < first + len(host)
        for category, kind in kinds:
            if kind == "soft":
                if whole:
                    met.setdefault(category, set()).add(term)
                    if len(met[category]) >= soft:
                        return True
            elif whole or kind == "stem" and in_host:
                return True
    return False


def _weigh(kinds: dict[str, list[tuple[str, str]]], soft: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A verdict for rows that have none yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for term, own in kinds.items():
            automaton.add_word(term, (term, own))
        automaton.make_automaton()
        for batch in batches:
            given, urls, hosts = (batch.column(c).to_pylist() for c in ("verdict", "folded", "host"))
            verdict = [v or ("block" if kinds and blocked(automaton, u or "", h, soft) else "allow") for v, u, h in zip(given, urls, hosts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return run


def fitting(rules: dict[str, str], host: Column, path: Column) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the last of the chain is asked first
        own, slash, start = rule.partition("/")
        out = F.when(((host == own) | host.endswith("." + own)) & path.startswith(slash + start), F.lit(rule)).otherwise(out)
    return out


def judge_urls(pages: DataFrame, rules: dict[str, str] | None = None, terms: DataFrame | list[Term] | None = None, soft: int = SOFT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; ``terms`` is a table of term, category, language, kind (strict, stem or soft)."""
    prepare(pages.sparkSession)
    rules = RULES if rules is None else rules
    url = F.coalesce("url", F.lit(""))
    part = lambda i: F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", i)
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), F.translate(part(1), *_FOLD).alias("host"), part(2).alias("path"), F.translate(url, *_FOLD).alias("folded"))
    ruled = split.withColumn("rule", fitting(rules, F.col("host"), F.col("path")))
    verdict = F.lit(None).cast("string")
    for rule, said in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(said)).otherwise(verdict)
    ruled = ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("folded")).alias("folded"))
    return ruled.mapInArrow(_weigh(kinds_of(terms), soft), "page_id long, host string, path string, rule string, verdict string")


def judge_sql() -> str:
    """The same verdicts as DuckDB SQL over ``pages``."""
    cases = "\n".join(f"      WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'" for r in sorted(RULES, key=len, reverse=True) for h, _, p in [r.partition("/")])
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES.items())
    fold = lambda x: f"translate({x}, '{_FOLD[0]}', '{_FOLD[1]}')"
    terms = ", ".join(f"('{t}', '{c}', '{k}')" for t, kinds in kinds_of(None).items() for c, k in kinds)
    return f"""
WITH terms(term, category, kind) AS (VALUES {terms}
), rest AS (
  SELECT page_id, {fold("coalesce(url, '')")} AS u, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS r FROM pages
), parts AS (
  SELECT page_id, u, {fold("regexp_extract(r, '^[^/?#]*')")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), ruled AS (
  SELECT *, CASE
{cases}
      END AS rule FROM parts
), asked AS (
  SELECT DISTINCT u, host FROM ruled WHERE rule IS NULL
), hits AS (
  SELECT u, host, term, category, kind, regexp_matches(u, '(^|[^a-z0-9])' || regexp_escape(term) || '([^a-z0-9]|$)') AS whole
  FROM asked JOIN terms ON contains(u, term)
), found AS (
  SELECT DISTINCT u, host FROM hits WHERE kind <> 'soft' AND (whole OR kind = 'stem' AND contains(host, term))
  UNION
  SELECT u, host FROM hits WHERE kind = 'soft' AND whole GROUP BY u, host, category HAVING count(DISTINCT term) >= {SOFT}
)
SELECT page_id, ruled.host, path, rule, CASE {verdicts} WHEN found.u IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN found ON rule IS NULL AND ruled.u = found.u AND ruled.host = found.host"""
