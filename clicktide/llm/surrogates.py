"""Personal data replaced by surrogates of the same kind and format.

Mentions are found by one pattern and taken apart into entities (a phone number
without its punctuation, the parts of a name, the value of a password).  Each
entity gets a surrogate from a keyed hash: as many digits, letters of the same
case and script, a given name of the same gender, a card number that passes the
same check digit test.  An entity has one surrogate in all documents, however it
is written, and surrogates that fall together, or that are an entity found in
the documents, are drawn again until all differ.  Rendered in the format of each
mention they replace it in the text.

Everything here is DataFrame operations.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktide.llm.common import documents, materialize
from clicktide.plans.skew import lookup_join

# Titles, and given names with their usual gender.
TITLES_M = ("Mr.", "Herr", "Monsieur", "Señor", "господин", "κύριος")
TITLES_F = ("Mrs.", "Ms.", "Miss", "Frau", "Madame", "Mme", "Señora", "госпожа", "κυρία")
TITLES_U = ("Dr.", "Prof.")
GIVEN_M = {
    "latin": "James John Robert Michael William David Thomas Charles Peter Paul Hans Karl Stefan Pierre Jean Luis Carlos Miguel Marco Antonio".split(),
    "cyrillic": "Иван Пётр Сергей Андрей Николай Михаил".split(),
    "greek": "Γιώργος Νίκος Κώστας Δημήτρης Παύλος Ηλίας".split(),
}
GIVEN_F = {
    "latin": "Mary Anna Linda Susan Karen Laura Emma Julia Claire Marie Sophie Greta Ingrid Heidi Carmen Lucia Elena Rosa Ines Teresa".split(),
    "cyrillic": "Анна Мария Ольга Елена Ирина Наталья".split(),
    "greek": "Μαρία Ελένη Κατερίνα Άννα Σοφία Ιωάννα".split(),
}
GIVEN_U = {"latin": "Robin Alex Sasha Kim Noel Jules".split(), "cyrillic": ["Саша", "Женя"], "greek": ["Άρης", "Φως"]}
WIDER = 8  # attempts after which a surrogate may come from a larger range
MOST_ATTEMPTS = 64
# One syllable for each hexadecimal digit.
SYLLABLES = {
    "latin": "ba den fel gor hal kin lor mar nes pol rin sel tor ven wal zan".split(),
    "cyrillic": "ба ден фел гор хал кин лор мар нес пол рин сел тор вен вал зан".split(),
    "greek": "βα δεν φελ γορ χαλ κιν λορ μαρ νες πολ ριν σελ τορ βεν καλ ζαν".split(),
}
ENDINGS = {"latin": "o a e".split(), "cyrillic": "ий а о".split(), "greek": "ος α ι".split()}  # for m, f, u
SCRIPTS = ("latin", "cyrillic", "greek")


def _any(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FOUR = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_HEX = "[0-9A-Fa-f]{1,4}"
# Addresses with ``::``.  Short ones that are code as well (``a[1::2]``, ``DB::add``) and ``::1`` are not meant.
_SHORTENED = (
    r"(?=[0-9A-Fa-f:]*\d|[Ff][CDcd])(?=[0-9A-Fa-f]{3}|(?::{0,2}[0-9A-Fa-f]{1,4}){3}|[0-9A-Fa-f:]*\.)(?:"
    + "|".join(
        [rf"(?:{_HEX}:){{{n}}}(?::{_HEX}){{0,{5 - n}}}:{_FOUR}" for n in range(1, 6)]
        + [rf"::(?:{_HEX}:){{0,5}}{_FOUR}"]
        + [rf"(?:{_HEX}:){{{n}}}(?::{_HEX}){{1,{7 - n}}}" for n in range(1, 7)]
        + [rf"(?:{_HEX}:){{1,7}}:", rf":(?::{_HEX}){{1,7}}"]
    )
    + ")"
)
_GAP = "[ ./\u00a0\u2011-]"  # between the digits of a phone number with a country code
_CAPITALISED = r"\p{Lu}[\p{L}'’-]*+"
_ALL_GIVEN = [n for pool in (GIVEN_M, GIVEN_F) for names in pool.values() for n in names]
PATTERNS = {
    "secret": r"(?<![\p{L}\p{N}])(?i:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key)"
    r"""["']?\s{0,3}[=:]\s{0,3}"""
    r"""(?:"(?:[^"\\\r\n]|\\.){4,}+"|'(?:[^'\\\r\n]|\\.){4,}+'|"[^"\r\n]{4,}"|'[^'\r\n]{4,}'|[^\s"',;]{4,})""",
    # a domain name has at most 127 labels; the bound also bounds the matcher's stack
    "email": r"(?<![\w.%+-])[\w.%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}(?![A-Za-z0-9])",
    "ipv6": r"(?<!\w)(?<![0-9A-Fa-f:]:)(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:])"
    rf"(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{6}}{_FOUR}|{_SHORTENED})(?!\w|:[\w:]|\.\d)",
    "ipv4": rf"(?<![\w.]){_FOUR}(?!\w|\.\d)",
    "aws_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]?\d{4}|\+\d{8,15}"
    rf"|\+\d{{1,3}}\)?{_GAP}?(?:\(\d{{1,5}}\){_GAP}?\d(?:{_GAP}?\d){{4,11}}|\d(?:{_GAP}?\d){{6,11}}))(?!\w)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]?\d|\w)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_any(TITLES_M + TITLES_F + TITLES_U)}) {_CAPITALISED}(?: {_CAPITALISED})?"
    rf"|(?:{_any(_ALL_GIVEN)}) {_CAPITALISED})",
}
MENTION = "|".join(f"(?:{p})" for p in PATTERNS.values())


# --- mentions and their parts -----------------------------------------------


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))


def kind_of(mention: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        found = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(found)
    return found


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _script(token: Column) -> Column:
    return (
        F.when(token.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(token.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    )


def _gender(token: Column, title: Column) -> Column:
    men, women = ([n for names in pool.values() for n in names] for pool in (GIVEN_M, GIVEN_F))
    told = F.initcap(F.lower(token))
    return (
        F.when(told.isin(men), "m").when(told.isin(women), "f")
        .when(title.isin(*TITLES_M), "m").when(title.isin(*TITLES_F), "f").otherwise("u")
    )


def parts_of(kind: Column, mention: Column) -> Column:
    """A mention as ``(kind, text)`` parts in a row; parts of kind ``keep`` stay as they are."""

    def part(of, text):
        return F.struct((F.lit(of) if isinstance(of, str) else of).alias("kind"), text.alias("text"))

    secret = r"""(?s)^([^=:]*[=:]\s*["']?)(.*?)(["']?)$"""
    secret_parts = F.array(
        part("keep", F.regexp_extract(mention, secret, 1)), part("secret", F.regexp_extract(mention, secret, 2)),
        part("keep", F.regexp_extract(mention, secret, 3)),
    )
    titles = _any(TITLES_M + TITLES_F + TITLES_U)
    title = F.regexp_extract(mention, rf"^({titles}) ", 1)
    rest = F.regexp_replace(mention, rf"^(?:{titles}) ", "")
    first, last = F.substring_index(rest, " ", 1), F.regexp_extract(rest, r"^\S+ (.+)$", 1)
    listed = F.initcap(F.lower(first)).isin(_ALL_GIVEN)

    def given(token):
        return F.concat_ws(":", F.lit("given"), _gender(token, title), _script(token))

    def surname(token):
        return F.concat_ws(":", F.lit("surname"), _script(token))

    name_parts = F.filter(
        F.array(
            part("keep", F.when(title != "", F.concat(title, F.lit(" "))).otherwise("")),
            part(F.when((last != "") | listed, given(first)).otherwise(surname(first)), first),
            part("keep", F.when(last != "", F.lit(" ")).otherwise("")),
            part(surname(last), last),
        ),
        lambda p: p["text"] != "",
    )
    return (
        F.when(kind == "secret", secret_parts).when(kind == "name", name_parts).otherwise(F.array(part(kind, mention)))
    )


def _ipv6(text: Column) -> tuple[Column, Column, Column]:
    """The groups of an address before and after its ``::`` (all after, if it has none), and its dotted end."""
    dotted = F.regexp_extract(text, r"(?:\d+\.){3}\d+$", 0)

    def pair(a, b):
        octets = [F.element_at(F.split(dotted, r"\."), at).cast("int") for at in (a, b)]
        return F.hex(octets[0] * 256 + octets[1])

    plain = F.when(
        dotted != "",
        F.concat(F.regexp_replace(text, r"(?:\d+\.){3}\d+$", ""), pair(1, 2), F.lit(":"), pair(3, 4)),
    ).otherwise(text)

    def groups(part):
        return F.filter(F.split(part, ":"), lambda g: g != "")

    before = F.when(F.contains(plain, F.lit("::")), F.substring_index(plain, "::", 1)).otherwise("")
    return groups(before), groups(F.substring_index(plain, "::", -1)), dotted


def _ipv6_norm(text: Column) -> Column:
    before, after, _ = _ipv6(text)
    whole = F.concat(before, F.array_repeat(F.lit("0"), 8 - F.size(before) - F.size(after)), after)
    return F.lower(F.array_join(F.transform(whole, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":"))


def normal_form(kind: Column, text: Column) -> Column:
    """What makes two parts the same entity."""
    return (
        F.when(kind == "phone", F.right(_digits(text), F.lit(10)))
        .when(kind.isin("card", "ssn"), _digits(text))
        .when(kind.isin("iban", "aws_key"), F.replace(text, F.lit(" "), F.lit("")))
        .when(kind.isin("ipv4", "secret"), text)
        .when(kind == "ipv6", _ipv6_norm(text))
        .otherwise(F.lower(text))
    )


# --- surrogates -------------------------------------------------------------


def _number(stream: Column, at: int) -> Column:
    """Two hexadecimal digits of a stream as a number."""
    return F.conv(F.substring(stream, at, 2), 16, 10).cast("int")


def _as_digits(stream: Column) -> Column:
    return F.translate(stream, "abcdef", "059274")


def masked(value: Column, stream: Column, keep_hex: bool = True) -> Column:
    """Every letter and digit of a value replaced by one of its class; hexadecimal text stays so with ``keep_hex``."""
    digits = _as_digits(stream)
    small = F.translate(stream, "0123456789", "ghkmpqstvx")

    def one(c, i):
        at = i % 128 + 1
        return (
            F.when(c.rlike(r"\d"), F.substr(digits, at, F.lit(1)))
            .when(c.rlike(r"\p{Lu}"), F.upper(F.substr(small, at, F.lit(1))))
            .when(c.rlike(r"\p{L}"), F.substr(small, at, F.lit(1)))
            .otherwise(c)
        )

    def hexadecimal(c, i):
        return F.when(c == ":", c).otherwise(F.substr(stream, i % 128 + 1, F.lit(1)))

    def each(f):
        return F.array_join(F.transform(F.split(value, ""), f), "")

    # the test of the whole value stands outside of the loops over its characters
    return F.when(value.rlike("^[0-9a-f:]{8,}$"), each(hexadecimal)).otherwise(each(one)) if keep_hex else each(one)


def _ipv6_like(norm: Column, stream: Column, zeros: Column) -> Column:
    """Groups of as many digits and letters; groups of zero stay while ``zeros``."""
    digits, letters = _as_digits(stream), F.translate(stream, "0123456789", "abcdefabcd")
    leading = F.translate(digits, "0", "8")

    def group(g, i):
        def one(c, j):
            at = i * 4 + j + 1
            return (
                F.when(~c.rlike(r"\d"), F.substr(letters, at, F.lit(1)))
                .when(j == 0, F.substr(leading, at, F.lit(1)))
                .otherwise(F.substr(digits, at, F.lit(1)))
            )

        filled = F.concat(F.substr(leading, i * 4 + 1, F.lit(1)), F.substr(stream, i * 4 + 2, F.lit(3)))
        return (
            F.when((g == "0") & zeros, g).when(g == "0", filled)
            .otherwise(F.array_join(F.transform(F.split(g, ""), one), ""))
        )

    return F.array_join(F.transform(F.split(norm, ":"), group), ":")


def _syllables(stream: Column, script: str, n: Column) -> Column:
    table = F.array(*[F.lit(s) for s in SYLLABLES[script]])
    picked = F.transform(
        F.split(F.substr(stream, F.lit(9), n), ""), lambda h: F.get(table, F.conv(h, 16, 10).cast("int"))
    )
    return F.initcap(F.array_join(picked, ""))


def _with_streams(entities: DataFrame, key: str) -> DataFrame:
    """``stream`` and ``domain_stream``, keyed hashes of an entity at an attempt and of its mail domain.

    They are columns so that drawing, which goes over the characters, hashes a value once.
    """
    domain = F.substring_index("norm", "@", -1)
    return entities.withColumn(
        "stream", F.sha2(F.concat_ws("\x01", F.lit(key), "kind", "norm", F.col("attempt").cast("string")), 512)
    ).withColumn("domain_stream", F.sha2(F.concat_ws("\x01", F.lit(key), F.lit("domain"), domain), 512))


def _draw(kind: Column, norm: Column, attempt: Column, stream: Column, of_domain: Column) -> Column:
    """The surrogate of an entity at an attempt; later attempts have more room to differ."""
    digits, size = _as_digits(stream), F.length(norm)

    def some(first, n):
        return F.substr(digits, F.lit(first), n)

    high = (_number(stream, 1) % 8 + 2).cast("string")  # 2 to 9
    phone = F.concat(high, some(2, size - 1))
    stem = F.concat(F.left(norm, F.lit(1)), some(2, size - 2))
    checked = F.get(F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.call_function("luhn_check", F.concat(stem, d))), 0)
    card = F.concat(stem, F.when(F.call_function("luhn_check", norm), checked).otherwise(some(100, F.lit(1))))
    lead = (
        F.when(norm.rlike(r"^10\."), F.lit("10")).when(norm.rlike(r"^192\.168\."), F.lit("192.168"))
        .otherwise((_number(stream, 1) % 89 + 11).cast("string"))
    )
    octets = [_number(stream, at).cast("string") for at in (3, 5, 7)]
    ipv4 = F.concat_ws(".", lead, F.when(~norm.rlike(r"^192\.168\."), octets[0]), octets[1], octets[2])
    # a private range that is nearly used up gives way to the larger one, and that to all addresses
    ipv4 = (
        F.when((attempt >= WIDER) & norm.rlike(r"^(10|192\.168)\.") & (attempt < 2 * WIDER), F.concat_ws(".", F.lit("10"), *octets))
        .when(attempt >= 2 * WIDER, F.concat_ws(".", (_number(stream, 1) % 223 + 1).cast("string"), *octets))
        .otherwise(ipv4)
    )
    ssn = F.when(attempt < WIDER, F.concat(F.lit("9"), some(2, F.lit(8)))).otherwise(some(1, F.lit(9)))
    domain = F.substring_index(norm, "@", -1)
    label = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1)
    email = F.concat(
        masked(F.substring_index(norm, "@", 1), stream), F.lit("@"), masked(label, of_domain), F.lit("."),
        F.substring_index(domain, ".", -1),
    )
    drawn = (
        F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", ssn)
        .when(kind == "ipv4", ipv4).when(kind == "email", email)
        .when(kind == "ipv6", _ipv6_like(norm, stream, attempt < WIDER))
        .when(kind == "aws_key", F.concat(F.left(norm, F.lit(4)), masked(F.expr("substring(norm, 5)"), stream, False)))
        .when(kind == "iban", F.concat(F.left(norm, F.lit(2)), masked(F.expr("substring(norm, 3)"), stream, False)))
    )
    for script in SCRIPTS:
        drawn = drawn.when(kind == f"surname:{script}", _syllables(stream, script, 3 + attempt))
        for g, (gender, pool) in enumerate(zip("mfu", (GIVEN_M, GIVEN_F, GIVEN_U))):
            names = F.array(*[F.lit(n) for n in pool[script]])
            made = F.concat(_syllables(stream, script, 1 + attempt), F.lit(ENDINGS[script][g]))
            listed = F.get(names, _number(stream, 1) % len(pool[script]))
            drawn = drawn.when(kind == f"given:{gender}:{script}", F.when(attempt == 0, listed).otherwise(made))
    drawn = drawn.otherwise(masked(norm, stream))
    # short values have few surrogates; these end the search
    longer = F.when((attempt >= WIDER) & kind.isin("secret", "email"), F.concat(F.left(stream, F.lit(6)), drawn))
    return F.coalesce(longer, drawn)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """A surrogate for each ``(kind, norm)``, such that no two of a kind share one and none is a real entity.

    Where the surrogates of a format run out, later attempts draw from a larger
    range of the kind.  Entities that still have none after ``MOST_ATTEMPTS`` are
    an error: there are more of them than surrogates.
    """
    entities = entities.select("kind", "norm").where("norm IS NOT NULL")
    pending = entities.withColumn("attempt", F.lit(0))
    settled = None
    for _ in range(MOST_ATTEMPTS):
        surrogate = _draw(*map(F.col, ("kind", "norm", "attempt", "stream", "domain_stream")))
        drawn = materialize(
            _with_streams(pending, key).withColumn("surrogate", surrogate).drop("stream", "domain_stream"), "drawn"
        )
        claims = drawn.select("kind", "surrogate", F.lit(1).alias("late"), "norm")
        if settled is not None:
            claims = claims.unionByName(settled.select("kind", "surrogate", F.lit(0).alias("late"), "norm"))
        owners = claims.groupBy("kind", "surrogate").agg(F.min(F.struct("late", "norm")).alias("owner"))
        real = entities.select(F.col("kind").alias("_kind"), F.col("norm").alias("_real"))
        drawn = drawn.withColumn("_told", normal_form(F.col("kind"), F.col("surrogate")))
        judged = drawn.join(owners, ["kind", "surrogate"]).join(
            real, (F.col("kind") == F.col("_kind")) & (F.col("_told") == F.col("_real")), "left"
        )
        judged = materialize(
            judged.select(
                "kind", "norm", "attempt", "surrogate",
                ((F.col("owner.late") == 1) & (F.col("owner.norm") == F.col("norm")) & F.col("_real").isNull()).alias("good"),
            ),
            "judged",
        )
        good = judged.where("good").select("kind", "norm", "surrogate")
        settled = good if settled is None else settled.unionByName(good)
        pending = judged.where("NOT good").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return settled
    raise ValueError(f"{pending.count()} entities have no surrogate after {MOST_ATTEMPTS} attempts")


# --- rendering and replacing ------------------------------------------------


def _ipv6_rendered(text: Column, surrogate: Column) -> Column:
    before, after, dotted = _ipv6(text)
    new, rest = F.split(surrogate, ":"), 8 - F.size(after)

    def fitted(groups, start):
        def one(g, i):
            told = F.get(new, start + i)
            return F.lpad(told, F.greatest(F.length(g), F.length(told)), F.lit("0"))

        return F.transform(groups, one)

    def octets(g):
        number = F.conv(g, 16, 10).cast("int")
        return F.concat_ws(".", F.floor(number / 256).cast("string"), (number % 256).cast("string"))

    last = fitted(after, rest)
    end = F.concat_ws(".", octets(F.get(new, F.lit(6))), octets(F.get(new, F.lit(7))))
    last = F.when(dotted != "", F.concat(F.slice(last, 1, F.size(after) - 2), F.array(end))).otherwise(last)
    left_out = F.slice(new, F.size(before) + 1, rest - F.size(before))
    between = F.when(F.forall(left_out, lambda g: g == "0"), F.lit("::")).otherwise(
        F.concat(
            F.when(F.size(before) > 0, F.lit(":")).otherwise(F.lit("")), F.array_join(left_out, ":"),
            F.when(F.size(after) > 0, F.lit(":")).otherwise(F.lit("")),
        )
    )
    return F.when(~F.contains(text, F.lit("::")), F.array_join(last, ":")).otherwise(
        F.concat(F.array_join(fitted(before, F.lit(0)), ":"), between, F.array_join(last, ":"))
    )


def rendered(kind: Column, text: Column, surrogate: Column) -> Column:
    """A surrogate in the format of a mention's part."""
    size = F.length(surrogate)

    def digit(c, i):
        # places count from the right, so that a country code stays in front
        rest = F.length(_digits(F.substr(text, i + 1)))
        told = c.rlike(r"\d") & (rest <= size)
        return F.when(told, F.substr(surrogate, size - rest + 1, F.lit(1))).otherwise(c)

    def spaced(c, i):
        place = F.length(F.replace(F.substr(text, F.lit(1), i + 1), F.lit(" "), F.lit("")))
        return F.when(c == " ", c).otherwise(F.substr(surrogate, place, F.lit(1)))

    def by_character(f):
        return F.array_join(F.transform(F.split(text, ""), f), "")

    shouted = (F.length(text) > 1) & (text == F.upper(text)) & (text != F.lower(text))
    return (
        F.when(kind == "keep", text)
        .when(kind.isin("phone", "card", "ssn"), by_character(digit))
        .when(kind.isin("iban", "aws_key"), by_character(spaced))
        .when(kind.isin("secret", "ipv4"), surrogate)
        .when((kind == "ipv6") & shouted, F.upper(_ipv6_rendered(text, surrogate)))
        .when(kind == "ipv6", _ipv6_rendered(text, surrogate))
        .when(shouted, F.upper(surrogate))
        .otherwise(surrogate)
    )


def mention_surrogates(found: DataFrame, key: str) -> DataFrame:
    """``mention, surrogate, n`` of every distinct mention; ``found`` has a mention per row."""
    kind, mention = F.col("kind"), F.col("mention")
    distinct = found.groupBy("mention").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", kind_of(mention))
    parts = materialize(
        distinct.select("mention", "n", F.posexplode(parts_of(kind, mention)).alias("at", "part"))
        .select("mention", "n", "at", "part.*")
        .withColumn("norm", normal_form(kind, F.col("text"))),
        "mention-parts",
    )
    replaced = parts.where("kind <> 'keep'")
    surrogates = assign(replaced.select("kind", "norm").distinct(), key)
    written = (
        replaced.join(surrogates, ["kind", "norm"])
        .withColumn("written", rendered(kind, F.col("text"), F.col("surrogate")))
        .select("mention", "n", "at", "written")
        .unionByName(parts.where("kind = 'keep'").select("mention", "n", "at", F.col("text").alias("written")))
    )
    whole = F.transform(F.sort_array(F.collect_list(F.struct("at", "written"))), lambda p: p["written"])
    return written.groupBy("mention").agg(F.array_join(whole, "").alias("surrogate"), F.first("n").alias("n"))


def replace_personal_data(docs: DataFrame, key: str, others: bool = False) -> DataFrame:
    """Replace every mention of personal data by its surrogate.

    Returns a row per row of ``docs`` (of which only ``doc_id`` and ``text`` are
    read): ``doc_id, text, n_replaced``.  A null or empty text is empty.  A text
    without mentions stays as it is; otherwise everything between mentions does.
    ``key`` decides all surrogates: the same key gives the same ones for the same
    documents.  Rows without an id and repeated rows are each replaced.  An empty
    table gives no row.  With ``others`` the remaining columns come along in a
    struct.  Texts may be of any length; a domain of more than 127 labels is none.
    """
    rows = documents(docs, others).withColumn("_hash", F.xxhash64("text"))
    found = materialize(
        rows.select("doc_id", "_hash", mentions(F.col("text")).alias("mentions")).where(F.size("mentions") > 0),
        "mentions",
    )
    each = found.select("doc_id", "_hash", F.posexplode("mentions").alias("at", "mention"))
    table = materialize(mention_surrogates(each.select("mention"), key), "mention-surrogates")
    # one mention may be that of a large part of all documents
    told = lookup_join(each, table, "mention", "n", ["doc_id", "_hash", "at"])
    of_row = told.groupBy("doc_id", "_hash").agg(
        F.transform(F.sort_array(F.collect_set(F.struct("at", "surrogate"))), lambda p: p["surrogate"]).alias("_new")
    )
    of_row = of_row.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_same"), "_new")
    between = F.split("text", MENTION, -1)
    text = F.array_join(
        F.flatten(F.zip_with(between, "_new", lambda kept, new: F.array(kept, F.coalesce(new, F.lit(""))))), ""
    )
    same = rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["_hash"] == F.col("_same"))
    return rows.join(of_row, same, "left").select(
        "doc_id", F.when(F.col("_new").isNull(), F.col("text")).otherwise(text).alias("text"),
        F.coalesce(F.size("_new"), F.lit(0)).alias("n_replaced"), *(["others"] if others else []),
    )
