"""Names, labels and client strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.identity import normalize_text

#: Spellings of handshake options by their short names, option orders of stock stacks, and folders of users: fixed values.
OPTION_NAMES = {"maxseg": "mss", "wscale": "ws", "window_scale": "ws", "sackok": "sok", "sack_perm": "sok", "sack_permitted": "sok", "timestamp": "ts", "timestamps": "ts"}
STACKS = {"mss,nop,ws,nop,nop,sok": "windows", "mss,sok,ts,nop,ws": "linux", "mss,nop,ws,nop,nop,ts,sok,eol": "darwin"}
USER_FOLDERS = (r"^([a-z]:\\users\\)[^\\]+(\\)", r"^(/home/)[^/]+(/)", r"^(/users/)[^/]+(/)")
#: What clients write of themselves (their makers' documentation): the token of each browser, most specific first, as others' tokens stand beside it; and of each platform.
BROWSERS = {"edge": ("Edg/", "EdgA/"), "chrome": ("Chrome/", "CriOS/"), "firefox": ("Firefox/", "FxiOS/"), "safari": ("Safari/",)}
PLATFORMS = {"ios": ("iPhone", "iPad"), "android": ("Android",), "chromeos": ("CrOS",), "windows": ("Windows NT",), "macos": ("Macintosh", "Mac OS X"), "linux": ("Linux", "X11")}
PLATFORM_STACKS = {"windows": "windows", "macos": "darwin", "ios": "darwin", "linux": "linux", "android": "linux", "chromeos": "linux"}
#: Categories of media: by subtype, which decides, and by top-level type. Fixed values.
MEDIA_SUBTYPES = {
    "archive": ("zip", "x-zip-compressed", "gzip", "x-gzip", "x-tar", "x-bzip2", "x-xz", "x-7z-compressed", "x-rar-compressed", "vnd.rar", "java-archive"),
    "executable": ("x-dosexec", "x-msdownload", "vnd.microsoft.portable-executable", "x-elf", "x-executable", "x-sharedlib", "x-mach-binary", "x-msi"),
    "document": ("pdf", "msword", "rtf", "vnd.ms-excel", "vnd.ms-powerpoint", "vnd.oasis.opendocument.text", *(f"vnd.openxmlformats-officedocument.{x}" for x in ("wordprocessingml.document", "spreadsheetml.sheet", "presentationml.presentation"))),
    "text": ("json", "xml", "javascript", "x-javascript", "x-www-form-urlencoded", "sql", "csv"),
    "certificate": ("x-x509-ca-cert", "x-pem-file", "pkix-cert", "pkcs7-mime", "x-pkcs12"),
}
MEDIA_TOPS = ("image", "video", "audio", "text", "font")
#: Strength of suites by their registered names, weakest first; what has no forward secrecy or no authentication is lower. Fixed values.
BROKEN_SUITES = ("NULL", "ANON", "EXPORT", "RC4", "DES_CBC", "3DES", "DES40", "IDEA", "SEED", "RC2", "MD5")
SUITE_TIERS = {
    1: r"TLS_RSA_WITH_AES_(128|256)_CBC_SHA(256)?",
    2: r"TLS_RSA_WITH_AES_(128_GCM_SHA256|256_GCM_SHA384)",
    3: r"TLS_(DHE_RSA_WITH_AES_(128|256)_CBC_SHA(256)?|ECDHE_(ECDSA|RSA)_WITH_AES_(128_CBC_SHA(256)?|256_CBC_SHA(384)?))",
    4: r"TLS_(DHE_RSA|ECDHE_ECDSA|ECDHE_RSA)_WITH_(AES_128_GCM_SHA256|AES_256_GCM_SHA384|CHACHA20_POLY1305_SHA256)",
    5: r"TLS_(AES_128_GCM_SHA256|AES_256_GCM_SHA384|CHACHA20_POLY1305_SHA256|AES_128_CCM_SHA256|AES_128_CCM_8_SHA256)",
}
TIER_NAMES = ("broken", "legacy", "legacy_aead", "forward_cbc", "forward_aead", "modern")


def char_counts(text: Column) -> Column:
    """array<struct<c, n>> of the characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)))


def shannon_entropy(text: Column) -> Column:
    """Bits a character; null for null or empty text."""
    n = F.length(text)
    total = F.aggregate(char_counts(text), F.lit(0.0), lambda a, k: a + (k / n) * F.log2(n / k))
    return F.when(n > 0, total)


def mean_label_length(name: Column) -> Column:
    """Mean length of the labels between dots; null without one."""
    labels = F.filter(F.split(name, r"\."), lambda x: x != "")
    total = F.aggregate(labels, F.lit(0), lambda a, x: a + F.length(x))
    return F.when(F.size(labels) > 0, total / F.size(labels))


def _named(text: Column, tokens: dict[str, tuple[str, ...]]) -> Column:
    """The first name one of whose tokens the text holds; null without one."""
    return F.coalesce(*(F.when(F.greatest(F.lit(False), *(text.contains(t) for t in held)), name) for name, held in tokens.items()))


def user_agent_family(agent: Column) -> Column:
    """A browser's family (``mozilla`` if a browser's header names none that is known), else the header's first product token in
    lower case; null without one."""
    own = F.trim(agent)
    product = F.lower(F.nullif(F.regexp_extract(own, r"^([A-Za-z][A-Za-z0-9._+-]*)", 1), F.lit("")))
    return F.when(own.startswith("Mozilla/"), F.coalesce(_named(own, BROWSERS), F.lit("mozilla"))).otherwise(product)


def user_agent_os(agent: Column) -> Column:
    """The platform that the header names; null if it names none."""
    return _named(F.trim(agent), PLATFORMS)


def stack_for(platform: Column) -> Column:
    """The network stack that a platform runs: windows, darwin or linux."""
    return F.coalesce(*(F.when(platform == name, stack) for name, stack in PLATFORM_STACKS.items()))


def media_category(kind: Column) -> Column:
    """Category of a media type, parameters aside: by its subtype, else by its top-level type; null if neither is known."""
    plain = F.lower(F.trim(F.substring_index(kind, ";", 1)))
    slash = F.instr(plain, "/")
    top, sub = F.substring_index(plain, "/", 1), F.substring(plain, slash + 1, F.length(plain))
    by_sub = F.coalesce(*(F.when(sub.isin(*held), name) for name, held in MEDIA_SUBTYPES.items()))
    return F.when(slash > 0, F.coalesce(by_sub, F.when(top.isin(*MEDIA_TOPS), top)))


def cipher_rank(name: Column) -> Column:
    """Strength of a TLS suite by its registered name, hyphens and blanks taken as underscores: 0 broken to 5 modern; null if unknown."""
    n = F.upper(F.regexp_replace(F.trim(name), r"[\s-]+", "_"))
    known = F.coalesce(*(F.when(n.rlike(f"^{pattern}$"), rank) for rank, pattern in SUITE_TIERS.items()))
    return F.when(n.rlike("|".join(BROKEN_SUITES)), 0).otherwise(known)


def cipher_tier(rank: Column) -> Column:
    """The rank's name."""
    return F.get(F.array(*(F.lit(t) for t in TIER_NAMES)), rank)


def public_suffix(df: DataFrame, name: str, rules: DataFrame) -> DataFrame:
    """df with public_suffix, registered_domain and subdomain of a dotted name.

    ``rules`` has a column ``rule`` in the public list's form (``com``, ``*.ck``, ``!www.ck``). The prevailing rule is an
    exception, else the one with most labels, else ``*``. Candidates of each distinct name join the rules by equality.
    """
    names = df.select(F.lower(F.regexp_replace(F.col(name), r"\.$", "")).alias("_n")).where("_n <> ''").distinct().withColumn("_l", F.split("_n", r"\."))
    cut = names.withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_l")))).withColumn("_tail", F.array_join(F.expr("slice(_l, _i, size(_l))"), "."))
    wild = F.concat(F.lit("*."), F.array_join(F.expr("slice(_l, _i + 1, size(_l))"), "."))
    forms = cut.select("_n", "_l", (F.size("_l") - F.col("_i") + 1).alias("_k"), F.explode(F.array(F.col("_tail"), wild, F.concat(F.lit("!"), F.col("_tail")))).alias("rule"))
    hit = forms.join(rules.select(F.lower("rule").alias("rule")).distinct(), "rule")
    hit = hit.withColumn("_e", F.col("rule").startswith("!")).withColumn("_k", F.col("_k") - F.col("_e").cast("int"))
    best = hit.groupBy("_n").agg(F.max_by("_k", F.struct("_e", "_k")).alias("_k"))
    known = names.join(best, "_n", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    known = known.select("_n", F.expr("array_join(slice(_l, -_k, _k), '.')").alias("public_suffix"), F.when(F.size("_l") > F.col("_k"), F.expr("array_join(slice(_l, -_k - 1, _k + 1), '.')")).alias("registered_domain"), F.when(F.size("_l") > F.col("_k") + 1, F.expr("array_join(slice(_l, 1, size(_l) - _k - 1), '.')")).alias("subdomain"))
    return df.withColumn("_n", F.lower(F.regexp_replace(F.col(name), r"\.$", ""))).join(known, "_n", "left").drop("_n")


def subdomain_entropy(subdomain: Column) -> Column:
    """Bits a character of a subdomain in lower case without its dots; null without one."""
    return shannon_entropy(F.regexp_replace(F.lower(subdomain), r"\.", ""))


def options_order(options: Column) -> Column:
    """Options of a handshake's first packet in their order, each by its short name; unknown ones as they are."""
    aliases = F.create_map(*(F.lit(x) for pair in OPTION_NAMES.items() for x in pair))
    parts = F.filter(F.split(F.lower(options), "[,; ]"), lambda p: F.trim(p) != "")
    short = F.transform(parts, lambda p: F.coalesce(F.try_element_at(aliases, F.trim(p)), F.trim(p)))
    return F.when(F.size(short) > 0, F.array_join(short, ","))


def stack_fingerprint(options: Column, mss: Column, window: Column) -> Column:
    """options|mss|window; a size that is no whole number is empty, and without options there is no fingerprint."""
    def whole(c: Column) -> Column:
        number = c.try_cast("double")
        return F.coalesce(F.when(number == F.floor(number), number.cast("long").cast("string")), F.lit(""))

    order = options_order(options)
    return F.when(order.isNotNull(), F.concat_ws("|", order, whole(mss), whole(window)))


def stack_family(options: Column) -> Column:
    order = options_order(options)
    return F.coalesce(*(F.when(order == known, family) for known, family in STACKS.items()))


def image_path(path: Column) -> Column:
    """A program's path in lower case, without quotes, with any user's folder as ``*``; null if empty."""
    text = F.lower(F.trim(F.trim(normalize_text(path), F.lit('"'))))
    for folder in USER_FOLDERS:
        text = F.regexp_replace(text, folder, "$1*$2")
    return F.when(text != "", text)


def quantize(value: Column, decimals: int = 4) -> Column:
    """Rounded half to even, by the number's shortest decimal form; null stays null and NaN stays NaN."""
    return F.when(F.isnan(value.cast("double")), F.lit(float("nan"))).otherwise(F.bround(value.cast("double"), decimals))


def period_start(moment: Column, period: str) -> Column:
    """The first instant of the moment's period: s, min (or T), H, D, M, Y; of W the Sunday that begins the week."""
    units = {"s": "second", "T": "minute", "min": "minute", "H": "hour", "D": "day", "M": "month", "Y": "year"}
    if period == "W":
        day = F.date_trunc("day", moment)
        return day - F.make_dt_interval(days=F.dayofweek(day) - 1)
    if period not in units:
        raise ValueError(f"unknown period: {period}")
    return F.date_trunc(units[period], moment)


def in_daily_window(t: Column, window: tuple[str, str]) -> Column:
    """Does t (nanoseconds) fall between two HH:MM times of the UTC day, the second left out, over midnight if need be?"""
    def second(clock: str) -> int:
        hours, minutes = map(int, clock.split(":"))
        if not (0 <= hours < 24 and 0 <= minutes < 60):
            raise ValueError(f"not an HH:MM time: {clock}")
        return hours * 3600 + minutes * 60

    start, end = map(second, window)
    if start == end:
        raise ValueError("a window that admits nothing")
    now = F.pmod(F.floor(t / 1_000_000_000), F.lit(86400))
    return (now >= start) & (now < end) if start < end else (now >= start) | (now < end)


def date_of_path(path: Column, pattern: str = r"(\d{4})-(\d{2})-(\d{2})(?:[T_ ](\d{2})[-_:]?(\d{2})[-_:]?(\d{2}))?", modified: Column | None = None) -> Column:
    """The moment that a file's name tells: groups of the pattern are year to second, missing ones start the day; else the
    file's own time, if given (``_metadata.file_modification_time``)."""
    part = lambda k: F.coalesce(F.regexp_extract(path, pattern, k).try_cast("int"), F.lit(0))
    told = F.try_make_timestamp(part(1), part(2), part(3), part(4), part(5), part(6).cast("decimal(8,6)"))
    found = F.when(F.regexp_extract(path, pattern, 1) != "", told)
    return F.coalesce(found, modified) if modified is not None else found
