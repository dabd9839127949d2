"""URL filter: logistic regression on hashed character n-grams of host and path.

Host and path are cut out in the JVM; their n-grams are hashed with different salts, so that a word counts
by where it stands. The labelled table is small and is a parameter of the query's function; where none is given,
seeds() makes one of words of many kinds of sites. Unwanted sites weigh PRIOR in the fit: what is known of no site is let through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textscan import chunks, expand, mix

BITS = 18
GRAMS = (3, 4, 5)
THRESHOLD = 0.5
PRIOR = 0.35  # of unwanted sites
LABELLED_MOST = 100_000  # labelled rows that are fitted on, at most
_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

# Words of addresses by what sites are about. They are common knowledge; none is taken from a table that is rated.
_BAD = """
casino casinos poker slot slots jackpot roulette blackjack baccarat craps bet bets betting bookmaker sportsbook gamble gambling lottery lotto bingo wager
porn porno xxx sex sexy adult adults nude nudes escort escorts camgirl cams webcam fetish erotic hookup hentai milf naked hotgirls singles
pill pills pharmacy viagra cialis levitra meds steroid steroids xanax tramadol valium ambien opioid weightloss slimming diet keto detox miracle cure
spam spammer scam phishing linkfarm clickfarm contentfarm spamfarm backlink backlinks seo traffic clickbait doorway autosurf paidtoclick popup popunder popads adserver adclick ads adtrack track tracker tracking
banner banners affiliate sponsor redirect cloak spy spyware malware trojan virus keylogger botnet exploit ransomware
warez crack cracked cracks keygen serials nulled torrent torrents pirate piratebay rip leaked bypass activator
loan loans payday cash fastcash getrich richquick income forex binary trading profit profits doubler bitcoin crypto airdrop giveaway prize winner win freebies free freemoney
replica replicas fake fakes counterfeit outlet knockoff cheap cheapest discount coupon wholesale rolex handbags
""".split()
_GOOD = """
news times journal herald gazette chronicle tribune post daily press magazine review letters notes essays stories editorial
university college school campus academy institute faculty library museum archive gallery theatre opera orchestra philharmonic
science physics chemistry biology astronomy geology mathematics statistics research laboratory medicine nursing dental clinic hospital hospice therapist therapy physician
government council city county parish police fire station court justice parliament embassy ministry treasury customs passport
garden gardening cooking recipes kitchen bakery restaurant cafe brewery vineyard farming farmers dairy orchard fishing sailing cycling hiking climbing skiing running football rugby cricket tennis golf
travel hotel hostel airline railway train bus ferry maps weather climate ocean river mountain forest wildlife birds bees horses dogs cats veterinary
history heritage genealogy archaeology philosophy language grammar dictionary encyclopedia wiki books poetry novel film cinema music guitar piano jazz folk
code docs developer programming python java linux kernel compiler database network protocol standards forum support help tutorial manual reference
bank insurance accounting tax law legal solicitor notary estate property housing architecture building plumbing electric carpentry furniture tools hardware
community charity church temple mosque synagogue volunteer foundation union society association club scouts
energy solar wind water recycling transport bridge harbour airport post parcel logistics
essex sussex middlesex wessex sextant bisexuality analysis analytics analyst assess assessment assembly assistant class classic classroom passage bass grass compass cockpit cocktail
peacock scunthorpe shiitake therapeutic title competition constitution institution document documents cumulus accumulate trace tracing trackwork betterment alphabet tibet abetting
winter window wine wing twin darwin adulteducation freedom freestyle freelance slotcar pokerface spider shipping pillar pillow caterpillar spain camshaft cameras camera loanword crypt cryptography cracker crackling
torrential warehouse advice adventure advent address adapt bannerman prizewinning scampi profitability rip ripple cheapside
""".split()
_ENDINGS = {1: "com net org info biz xyz top click online site club shop win bid loan".split(), 0: "com net org edu gov info io ac.uk co.uk org.uk de fr es it nl ca com.au co.jp eu int".split()}
_BAD_PATHS = ("", "/", "/bonus", "/free-spins", "/signup?aff={k}", "/buy-cheap-{w}", "/click?id={k}", "/go.php?url={k}", "/win/{k}", "/{w}-online-{k}.html", "/download/{w}-crack", "/landing/{k}", "/best-{w}", "/promo/{w}", "/pop/{k}.js")
_GOOD_PATHS = ("", "/", "/about", "/contact", "/news/20{y}/0{m}/{w}", "/wiki/{w}", "/docs/{w}/index.html", "/articles/{k}", "/research/{w}", "/blog/{w}-{v}", "/events/{k}", "/en/{w}", "/library/{w}.pdf", "/page/{k}", "/store/{w}?item={k}")

_SHARED = ("com", "com", "net", "org", "info", "co", "io")
_HOSTS = ("example.", "hosting.", "pages.", "site.", "web.", "server.", "cloud.")
_PLAIN = ("", "", "/", "/{k}", "/{l}", "/{l}/{k}", "/page/{k}", "/page/{k}.html", "/index.html", "/p/{k}", "/item/{k}/", "/{l}/page/{k}")


def seeds(without: frozenset[str] = frozenset()) -> list[tuple[str, int]]:
    """A small labelled table of addresses: 1 for unwanted. without: words that are left out, to measure what is learned of the others."""
    rng = np.random.default_rng(3)
    out = []
    for label, words in ((1, _BAD), (0, _GOOD)):
        words = [w for w in dict.fromkeys(words) if w not in without]
        ends, paths = _ENDINGS[label], (_BAD_PATHS, _GOOD_PATHS)[1 - label]
        for k, word in enumerate(words):
            for _ in range(20):
                mate, third = (words[int(i)] for i in rng.integers(0, len(words), 2))
                number = int(rng.integers(1, 999))
                name = (word, f"{word}-{mate}", f"{word}{mate}", f"{mate}-{word}", f"{mate}{word}", f"{word}{number}", f"{word}-{mate}-{third}", f"{word}-{number}")[int(rng.integers(0, 8))]
                sub = ("", "", "www.", "www.", "m.", "blog.", "en.", "shop.", "news.")[int(rng.integers(0, 9))]
                # most addresses have nothing but the name to tell them by: common endings and plain paths, often at a host of many sites
                plain = rng.random() < 0.75
                end = _SHARED[int(rng.integers(0, len(_SHARED)))] if plain else ends[int(rng.integers(0, len(ends)))]
                path = _PLAIN[int(rng.integers(0, len(_PLAIN)))] if plain else paths[int(rng.integers(0, len(paths)))]
                path = path.format(k=number, w=third, v=mate, y=int(rng.integers(10, 26)), m=int(rng.integers(1, 10)), l=("en", "fr", "de", "es", "it")[int(rng.integers(0, 5))])
                host = _HOSTS[int(rng.integers(0, len(_HOSTS)))] if rng.random() < 0.4 else ""
                out.append((f"http{'s' * int(rng.integers(0, 2))}://{sub}{name}.{host}{end}{path}", label))
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^@/?#]*@)?([^:/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1))


def features(column: pa.Array, salt: np.uint64) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, row, bucket) of the n-grams of runs of rows, with a mark at either end of each string."""
    for i, j, offs, data in chunks(column):
        size = np.diff(offs)
        owner, k = expand(size + 2)
        inner = (k > 0) & (k <= size[owner])
        raw = np.full(len(owner), 1, np.uint64)
        raw[inner] = data[offs[owner[inner]] + k[inner] - 1]
        raw[k == 0] = 2
        rows, buckets = [], []
        for n in GRAMS:
            m = max(0, len(raw) - n + 1)
            code = np.zeros(m, np.uint64)
            for t in range(n):
                code = (code << np.uint64(8)) | raw[t : t + m]
            same = owner[:m] == owner[n - 1 : n - 1 + m]
            rows.append(owner[:m][same])
            buckets.append((mix(code[same] ^ np.uint64(int(salt) * n % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int64))
        yield i, j, np.concatenate(rows), np.concatenate(buckets)


def design(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value): n-grams of host and path, each part scaled to its number."""
    parts = []
    for column, salt in zip((host, path), _SALTS, strict=True):
        for i, j, row, bucket in features(column, salt):
            parts.append((row + i, bucket, 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=j - i)))[row]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def fit(host: pa.Array, path: pa.Array, label: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias, by AdaGrad on all labelled rows; unwanted ones weigh PRIOR in all."""
    weights, bias = np.zeros(1 << BITS), 0.0
    n = len(label)
    if not n:
        return weights.astype(np.float32), -20.0
    row, bucket, value = design(host, path)
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    each = np.where(label == 1, PRIOR / share, (1 - PRIOR) / (1 - share)) / n
    seen, seen_bias = np.full(1 << BITS, 1e-6), 1e-6
    for _ in range(rounds):
        z = np.bincount(row, value * weights[bucket], minlength=n) + bias
        error = each * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label)
        g = np.bincount(bucket, value * error[row], minlength=1 << BITS) + 1e-5 * weights
        seen += g * g
        seen_bias += error.sum() ** 2
        weights -= 0.3 * g / np.sqrt(seen)
        bias -= 0.3 * error.sum() / np.sqrt(seen_bias)
    return weights.astype(np.float32), float(bias)


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> tuple[np.ndarray, float]:
    """Fitted on the labelled rows, at most LABELLED_MOST of them, in order of a hash; rows with a null in either column aren't used."""
    rows = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("int").alias("label")).where("url is not null and label in (0, 1)")
    got = rows.select("url", "label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).orderBy(F.xxhash64("url"), "url", "label").limit(LABELLED_MOST).toArrow()
    return fit(got.column("host").combine_chunks(), got.column("path").combine_chunks(), got.column("label").to_numpy().astype(float))


def rate(pages: DataFrame, model: tuple[np.ndarray, float], id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each page: page_id, url, host, score (probability of unwanted), blocked (score at the threshold or above).

    A null or blank URL has a null host and score and isn't blocked. A URL without scheme has no host, and is
    rated by its path. Very long URLs are rated whole. Repeated rows are rated each time and alike, a null page_id stays
    null. Other columns are ignored, whatever their names. An empty table gives no rows, and labels of no rows block nothing.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)  # 1 MB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            row, bucket, value = design(batch.column(3), batch.column(4))
            z = np.bincount(row, value * weights[bucket], minlength=batch.num_rows) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(p), pa.array(p >= threshold)], names=["page_id", "url", "host", "score", "blocked"])

    some = F.length(F.trim(F.col("url"))) > 0
    cut = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).select("page_id", "url", F.when(some, host_of(F.col("url"))).alias("shown"), F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    rated = cut.mapInArrow(score, "page_id long, url string, host string, score double, blocked boolean")
    return rated.withColumns({"score": F.when(some, F.col("score")), "blocked": F.coalesce(some, F.lit(False)) & F.col("blocked")})


def query(spark: SparkSession, sf_dir: str, labelled: DataFrame | None = None) -> DataFrame:
    return rate(table(spark, sf_dir, "pages"), train(labelled if labelled is not None else spark.createDataFrame(seeds(), "url string, label int")))
