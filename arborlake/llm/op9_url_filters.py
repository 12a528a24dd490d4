"""URL filters: host and path rules first, then logistic regression on hashed character n-grams of host
and path. Scoring is one projection of DataFrame functions; no shuffle, no Python.

The model is trained on the driver from the small labelled table below. Weights are whole numbers
(millionths), so sums do not depend on their order.

Defined cases: a null url, or one without `://`, has an empty host and path, so the model judges the
empty string; rows are judged one by one, so repeated rows return as often as they came; of rules
that fit, the longest wins, and of equally long ones the first in order; urls may be of any length; an
empty table gives no rows; only the id and url columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Buckets of the hashed n-grams and the lengths of n-grams.
BUCKETS, SIZES = 4096, (3, 4)

#: The labelled URL table: parts of hosts and paths, each combined with the others of its row.
LABELLED = {
    "block": (
        ["bestcasino", "casinoroyal", "poker-bonus", "freeslots", "slots-jackpot", "bet365x", "sportsbetting", "winbigcash", "lottery-winner", "spamlinks", "linkfarm", "spammy-seo", "buy-backlinks", "xxxtube", "adultvideos", "adult-chat", "pornhd", "sexcams", "camgirls", "hotdating", "viagra-online", "cheappills", "pharmacy-discount", "weightloss-miracle", "warezcity", "keygen-crack", "cracked-apps", "torrent-pirate", "payday-loans", "fastcredit-now", "secure-login-verify", "account-phishing", "freegiftcards", "replica-watches", "casino", "poker", "porn", "viagra", "spam", "betting", "jackpot", "lottery", "escort", "pills", "warez", "phishing"],
        ["/win/jackpot", "/xxx/gallery", "/buy-now/cheap", "/bonus/free-spins", "/login/verify.php", "/adult/cams"],
    ),
    "allow": (
        ["news", "dailyherald", "library", "science", "museum", "weather", "university", "recipes", "gardening", "history", "citycouncil", "opensource", "physics", "mathematics", "literature", "orchestra", "railways", "hospital", "archive", "encyclopedia", "theatre", "photography", "astronomy", "cooking", "travelguide", "localnews", "documentation", "tutorials", "research", "environment", "agriculture", "parliament", "linguistics", "ourvillage", "blog", "school", "music", "forum", "wiki", "garden", "bakery", "books", "festival", "hiking", "language", "church"],
        ["/docs/intro", "/articles/2021", "/about", "/events/spring", "/research/papers.html", "/index.html"],
    ),
}
PREFIXES, TOPS = ["", "www.", "blog.", "m."], ["com", "org", "net"]
#: From this probability on a url is blocked.
BLOCK_FROM = 0.6

#: (host, path) rules; the verdict holds for the host and its subdomains where the path starts so.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 if to be blocked) of the training table."""
    return [
        (f"{pre}{name}.{top}", path, int(label == "block"))
        for label, (names, paths) in LABELLED.items()
        for i, name in enumerate(names)
        for pre in PREFIXES
        for j, top in enumerate(TOPS)
        for path in paths[(i + j) % 2 :: 2]
    ]


def buckets(s: str) -> list[int]:
    """The n-grams' buckets: a polynomial of the characters' codes, as in the SQL."""
    codes = [ord(c) for c in s]
    out = []
    for n in SIZES:
        for i in range(len(codes) - n + 1):
            h = n
            for c in codes[i : i + n]:
                h = (h * 31 + c) % 1_000_003
            out.append(h % BUCKETS)
    return out


@lru_cache
def train(rounds: int = 300, rate: float = 1.0, decay: float = 1e-4) -> tuple[int, tuple[int, ...]]:
    """Bias, less the log-odds of BLOCK_FROM, and weights in millionths, by full-batch gradient descent."""
    rows = labelled_urls()
    x = np.zeros((len(rows), BUCKETS))
    for i, (host, path, _) in enumerate(rows):
        for b in buckets(f"^{host}{path}$"):
            x[i, b] += 1
    x /= np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
    y = np.array([r[2] for r in rows], float)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) * share
        w -= rate * 10 * (x.T @ g + decay * w)
        b -= rate * g.sum()
    return round((b - float(np.log(BLOCK_FROM / (1 - BLOCK_FROM)))) * 1e6), tuple(int(v) for v in np.round(w * 1e6))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the rules see them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        out = F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), F.lit(rule)).otherwise(out)
    return out


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Id, host, path, rule, verdict and the model's sum (millionths, before the square root of the length)."""
    bias, weights = train()
    host, path = url_parts(F.col(url_col))
    d = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    d = d.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    d = d.withColumn("codes", F.expr("CASE WHEN rule IS NULL THEN transform(split(concat('^', host, path, '$'), ''), c -> ascii(c)) END"))
    total, n_grams = F.lit(0).cast("long"), F.lit(0)
    for n in SIZES:
        h = str(n)
        for k in range(n):
            h = f"(({h}) * 31 + codes[i + {k}]) % 1000003"
        ids = F.expr(f"CASE WHEN size(codes) >= {n} THEN transform(sequence(0, size(codes) - {n}), i -> cast(({h}) % {BUCKETS} AS int)) ELSE cast(array() AS array<int>) END")
        d = d.withColumn(f"grams{n}", ids)
        total = total + F.aggregate(f"grams{n}", F.lit(0).cast("long"), lambda s, g: s + F.get(F.col("weights"), g))
        n_grams = n_grams + F.size(f"grams{n}")
    d = d.withColumn("weights", F.expr("from_json('%s', 'array<bigint>')" % str(list(weights)).replace(" ", "")))
    d = d.withColumn("model_sum", F.when(F.col("rule").isNull(), total)).withColumn("n_grams", F.when(F.col("rule").isNull(), n_grams))
    # sum / sqrt(n) + bias > 0, in whole numbers
    blocked = blocks(F.col("model_sum"), F.col("n_grams"), bias)
    verdict = F.when(blocked, "block").otherwise("allow")
    for rule, says in rules:
        verdict = F.when(F.col("rule") == rule, says).otherwise(verdict)
    return d.withColumn("verdict", verdict).select("page_id", "host", "path", "rule", "verdict", "model_sum")


def blocks(total: Column, n: Column, bias: int) -> Column:
    return total.cast("double") + F.lit(float(bias)) * F.sqrt(n.cast("double")) > 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def sql() -> str:
    bias, weights = train()
    cases = " ".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
        for r, _ in sorted(RULES, key=lambda r: -len(r[0]))
    )
    says = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
    grams = []
    for n in SIZES:
        h = str(n)
        for k in range(n):
            h = f"(({h}) * 31 + codes[i + {k}]) % 1000003"
        grams.append(f"list_transform(range(1, len(codes) - {n} + 2), lambda i: ({h}) % {BUCKETS})")
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {cases} END AS rule FROM b),
d AS (SELECT *, CASE WHEN rule IS NULL THEN list_transform(string_split('^' || host || path || '$', ''), lambda c: unicode(c)) END AS codes FROM c),
e AS (SELECT *, list_concat({", ".join(grams)}) AS grams FROM d),
w AS (SELECT {list(weights)} AS weights),
f AS (SELECT e.*, CASE WHEN rule IS NULL THEN list_sum(list_transform(grams, lambda g: weights[g + 1]))::BIGINT END AS model_sum FROM e, w)
SELECT page_id, host, path, rule, CASE rule {says} ELSE CASE WHEN model_sum + {float(bias)} * sqrt(len(grams)) > 0 THEN 'block' ELSE 'allow' END END AS verdict, model_sum FROM f
"""
