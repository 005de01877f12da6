"""Secret scan with a randomness test battery, in DataFrame operations only.

Base patterns are found with their places: the pieces between the matches of a
pattern and the matches themselves alternate, so running sums of their lengths
are the places.  Further candidates are long runs of the characters that keys are
written in.  From its characters each candidate's encoding is inferred, and
against uniform symbols of that alphabet three tests are made: chi-squared over
bins of symbols, runs about the middle of the alphabet, and serial correlation.
Their combined p-value says how far a token is from random.

False discoveries are controlled among what is *reported*: the null hypothesis is
ordinary text.  The whole text of every document, but for candidates, is cut into pieces
for each encoding, with the characters outside the alphabet left out, and the battery
measures all these pieces as it measures candidates; so the whole corpus says, by
encoding and length, how random text looks.  A candidate's p-value under that null is the probability that
a piece of text of its encoding and length looks as random, and Benjamini and
Hochberg's rule chooses the discoveries within each stratum of encoding and length:
of the reported tokens a share ``ALPHA`` is expected to be text.  Short tokens and
small alphabets look less unlike text, so there more evidence is asked.  Equal tokens
are one test.  Moments of text and p-values of tokens are gathered by stratum in
tables of fixed size, so nothing unbounded is gathered, and pieces are never written down.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import materialise

ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
#: runs that may be keys
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: a text without any of these has neither base matches nor candidates
ANY = r"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z0-9+/_-]{20}"

#: encodings in the order they are tried: name, what such tokens match, symbols in order
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789"),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)

#: expected share of ordinary text among the tokens reported
ALPHA = 0.05
#: steps of the histogram for each power of ten, and its length
STEPS, LEVELS = 8, 160
#: shortest and longest length at which text is cut for the null, and all between in the order they are taken
SHORTEST, LONGEST = 20, 64
LENGTHS = tuple(SHORTEST + 7 * k % (LONGEST - SHORTEST + 1) for k in range(LONGEST - SHORTEST + 1))
#: symbols of text in a block
BLOCK = 10 * LONGEST
#: least standard deviation of the null, as few pieces vary little by luck
LEAST_SPREAD = 0.25
#: bins of the coarse test of uniformity
COARSE = 5
#: letters that stand for bins, consecutive in ASCII and as many as the largest alphabet has symbols
LETTERS = "".join(map(chr, range(48, 112)))
#: symbols in a word, a number whose bytes they and the next symbol are, so that no sum reaches the sign
WORD = 6
#: longest token whose words are columns; its sums fit into one number, as 84 squares of a letter are below 2^20
PACKED = 14 * WORD
#: a number with 1 in every byte of a word, and one with the highest bit of the bytes of its own symbols
ONES, HIGHEST = int("01" * (WORD + 1), 16), int("80" * WORD + "00", 16)
#: matches whose places are summed together
PLACES = 512
#: places between the beginnings of two copies of the prose
PROSE_STEP = 16
#: ordinary prose that stands for text where a corpus has none
PROSE = (
    "In the morning the children walked along the river to the old mill, where Mr Miller sold bread for 25 cents a loaf and told them stories of the years before 1900. When it rained they "
    "stayed under the roof and counted boats; on Sundays there were 10 or 12 of them, with flags in red and blue. Nobody asked who owned the meadow behind the house, for everyone thought "
    "that it belonged to the village. Later, in 1935, a railway was built across it, and the Quiet Valley Company put up a station with 3 platforms, a waiting room and a clock that was "
    "always wrong by 7 minutes. My grandmother kept the first ticket ever sold there, number 000148, in a box together with letters, buttons and a photograph of the mayor."
)


def _cdf(z: str) -> str:
    """Normal distribution function, to some thousandths of its value in the middle."""
    return f"(1 / (1 + exp(-greatest(-40D, least(40D, 1.5976 * {z} + 0.070565992 * {z} * {z} * {z})))))"


_SPAN = "array<struct<start: int, rank: int, end: int, kind: string, body: string>>"
_STEP = "array<struct<m: int, b: string, gap: int>>"


def _steps(pattern: str, group: int = 0) -> Column:
    """Of each leftmost match its length, body and the length of the text before it; what follows the last one has no m."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    whole, parts = f"regexp_extract_all(text, '{quoted}', 0)", f"split(text, '{quoted}', -1)"
    body = f"regexp_extract_all(text, '{quoted}', {group})" if group else whole
    both = f"zip_with({whole}, {body}, (m, b) -> named_struct('m', char_length(m), 'b', b))"
    return F.expr(f"zip_with({both}, {parts}, (x, g) -> named_struct('m', x.m, 'b', x.b, 'gap', char_length(g)))")


def _spans(name: str, rank: int, kind: str, least: int) -> Column:
    """Spans of all matches, code points, as structs (start, rank, end, kind, body).

    Places are summed within blocks of matches and over the blocks, so that a text with
    many matches costs little more than its length."""
    first = f"""aggregate({name}, named_struct('at', 0, 'out', cast(array() as array<int>)),
        (s, block) -> named_struct('at', s.at + aggregate(block, 0, (n, x) -> n + x.gap + coalesce(x.m, 0)), 'out', concat(s.out, array(s.at))), s -> s.out)"""
    inside = f"""aggregate(block, named_struct('at', at, 'out', cast(array() as {_SPAN})),
        (s, x) -> if(x.m is null, s, named_struct('at', s.at + x.gap + x.m, 'out', concat(s.out,
          array(named_struct('start', s.at + x.gap, 'rank', {rank}, 'end', s.at + x.gap + x.m, 'kind', '{kind}', 'body', x.b))))), s -> s.out)"""
    return F.expr(f"filter(flatten(zip_with({name}, {first}, (block, at) -> {inside})), s -> char_length(s.body) >= {least})")


def places(docs: DataFrame) -> DataFrame:
    """doc_id, text, some (a match is possible) and the spans of each kind of match."""
    kinds = {"assign": (ASSIGN, 0, "assign", 2, 12), "access": (ACCESS, 1, "access", 0, 0), "hex": (HEX, 2, "hex", 0, 0), "maybe": (CANDIDATE, 3, "random", 0, 0)}
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("some", F.col("text").rlike(ANY))
    found = text.withColumns({name: F.when(F.col("some"), _steps(pattern, group)).otherwise(F.expr(f"cast(array() as {_STEP})")) for name, (pattern, _, _, group, _) in kinds.items()})
    blocks = {name: F.expr(f"transform(sequence(0, (size({name}) - 1) div {PLACES}), c -> slice({name}, c * {PLACES} + 1, {PLACES}))") for name in kinds}
    found = found.withColumns({name: F.when(F.size(name) > 0, c).otherwise(F.expr(f"cast(array() as array<{_STEP}>)")) for name, c in blocks.items()})
    return found.select("doc_id", "text", "some", *(_spans(name, rank, kind, least).alias(name) for name, (_, rank, kind, _, least) in kinds.items()))


def _of_encoding(values) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.col("encoding") + 1)


def _encoding(token: Column) -> Column:
    """Number of the first encoding that a token may be written in."""
    return F.coalesce(*(F.when(token.rlike(pattern) if pattern else F.lit(True), k) for k, (_, pattern, _) in enumerate(ENCODINGS)))


def _written(encoding: int) -> tuple[str, list[int]]:
    """The characters an encoding is written in, capitals of hex and the other two of base64 included, and their symbols."""
    symbols = ENCODINGS[encoding][2]
    more = {1: ("ABCDEF", 10), 3: ("-_", 62)}.get(encoding, ("", 0))
    return symbols + more[0], [*range(len(symbols)), *range(more[1], more[1] + len(more[0]))]


def _cells(encoding: int, bins: int, narrow_first: bool = False) -> str:
    """For each character of an encoding the letter of its symbol's bin; narrow bins may have the first letters."""
    widths = _widths(encoding, bins)
    at = sorted(range(bins), key=widths.__getitem__) if narrow_first else range(bins)
    letter = dict(zip(at, LETTERS))
    return "".join(letter[v * bins // len(ENCODINGS[encoding][2])] for v in _written(encoding)[1])


def _widths(encoding: int, bins: int) -> list[int]:
    """How many symbols each bin holds."""
    size = len(ENCODINGS[encoding][2])
    return [sum(v * bins // size == b for v in range(size)) for b in range(bins)]


def _wide(encoding: int, bins: int) -> str:
    """The first letter of the bins that hold a symbol more than the narrow ones."""
    widths = _widths(encoding, bins)
    return chr(ord(LETTERS[0]) + widths.count(min(widths)))


def _edge(encoding: int, bins: int, b: int) -> int:
    """What brings the symbols of bin ``b`` and above, and no others, to 128 or more when it is added to each byte of a word."""
    first = -(-b * len(ENCODINGS[encoding][2]) // bins)
    return (128 - ord(LETTERS[0]) - first) * ONES


def _over_words(of) -> str:
    """The sum of the SQL ``of(word)`` over all words of a token."""
    return f"if(n <= {PACKED}, {' + '.join(of(f'w{c}') for c in range(PACKED // WORD))}, aggregate(words, 0L, (s, w) -> s + {of('w')}))"


def _symbols(term):
    """What gives for a word the sum of the SQL ``term(symbol, next)`` over its symbols."""
    byte = lambda w, k: f"(shiftright({w}, {8 * (WORD - k)}) & 255L)"
    return lambda w: "(" + " + ".join(term(byte(w, k), byte(w, k + 1)) for k in range(WORD)) + ")"


def _sums(tokens: DataFrame) -> DataFrame:
    """Adds to rows with n, ``encoding`` and ``values``, the letters of the symbols: the numbers of symbols from each edge of the coarse
    bins on (from_1, ...) and in the lower half (low), runs about the middle, and of the letters' codes their total, squares, lagged products and ends.

    ``WORD`` symbols and the next one are the bytes of a number, so that an addition and a count of bits compare them all with
    an edge.  Words of tokens of at most ``PACKED`` symbols are columns and their sums generated code; longer ones have an array of words."""
    word = lambda c: f"coalesce(cast(conv(hex(substring(bytes, {c} * {WORD} + 1, {WORD + 1})), 16, 10) as bigint), 0L)"
    each = range(len(ENCODINGS))
    tokens = tokens.withColumn("bytes", F.expr(f"concat(cast(values as binary), X'{'00' * WORD}')"))
    words = {f"w{c}": F.expr(f"if(n > {c * WORD} and n <= {PACKED}, {word(c)}, 0L)") for c in range(PACKED // WORD)}
    tokens = tokens.withColumns(words | {"words": F.expr(f"if(n > {PACKED}, transform(sequence(0, (n - 1) div {WORD}), c -> {word('c')}), NULL)")}).drop("bytes")
    edges = {f"edge_{b}": _of_encoding(_edge(k, COARSE, b) for k in each) for b in range(1, COARSE)} | {"middle": _of_encoding(_edge(k, 2, 1) for k in each)}
    tokens = tokens.withColumns(edges | {"first": F.expr("cast(ascii(values) as long)"), "last": F.expr("cast(ascii(substring(values, n, 1)) as long)")})
    above = lambda edge: lambda w: f"bit_count(({w} + {edge}) & {HIGHEST}L)"
    # From bit 0, 20 and 40 the products, the squares and the total of a token whose words are columns; nothing follows its last symbol but zeros.
    packed = _symbols(lambda x, y: f"{x} * ({y} + {x} * {2**20}L + {2**40}L)")
    tokens = tokens.withColumns(
        {f"from_{b}": F.expr(_over_words(above(f"edge_{b}"))) for b in range(1, COARSE)}
        | {
            "high": F.expr(_over_words(above("middle"))),
            "turns": F.expr(_over_words(lambda w: f"bit_count((({w} + middle) ^ shiftleft({w} + middle, 8)) & {HIGHEST}L)")),
            "sums": F.expr(f"if(n <= {PACKED}, {' + '.join(map(packed, words))}, NULL)"),
            "ends": F.expr("first + last"),
        }
        | {
            f"long_{name}": F.expr(f"if(n <= {PACKED}, NULL, aggregate(words, 0L, (s, w) -> s + {_symbols(term)('w')}))")
            for name, term in {"total": lambda x, y: x, "squares": lambda x, y: f"{x} * {x}", "products": lambda x, y: f"{x} * {y}"}.items()
        }
        | {"last": F.expr("((last + middle) & 255L) >= 128L")}
    )
    tokens = tokens.withColumns(
        {
            "low": F.expr("n - high"),
            "runs": F.expr("turns + 1 - cast(last as int)"),
            "total": F.expr("coalesce(long_total, shiftright(sums, 40))"),
            "squares": F.expr(f"coalesce(long_squares, shiftright(sums, 20) & {2**20 - 1}L)"),
            "products": F.expr(f"coalesce(long_products, sums & {2**20 - 1}L)"),
        }
    )
    return tokens.drop(*words, *edges, "words", "first", "last", "high", "turns", "sums", "long_total", "long_squares", "long_products")


def _normal(chi: str, bins: str) -> str:
    """Chi-squared over ``bins`` bins as a normal variable."""
    return f"(power(greatest(0D, {chi}) / ({bins} - 1), 1D / 3) - (1 - 2D / (9 * ({bins} - 1)))) / sqrt(2D / (9 * ({bins} - 1)))"


def battery(tokens: DataFrame) -> DataFrame:
    """Adds n, stratum, p and far to rows with ``token`` and ``encoding``, and drops the token.

    p is the smallest p of the tests (uniformity is tested twice) times four, against a random token; far is
    the root of -log10 p, about normal for text.  The cost is linear in the token's length.  Uniformity over
    many bins comes last: once another test gives 0, so is p, and it is not computed."""
    sizes, each = [len(s) for _, _, s in ENCODINGS], range(len(ENCODINGS))
    tokens = tokens.withColumns({"n": F.char_length("token"), "size": _of_encoding(sizes), "written": _of_encoding(_written(k)[0] for k in each)})
    tokens = tokens.withColumn("letters", _of_encoding(_cells(k, sizes[k]) for k in each))
    tokens = _sums(tokens.withColumn("values", F.expr("translate(token, written, letters)")).drop("letters"))
    # Uniformity over few bins, which part cases and digits.  Expected counts follow the number of symbols
    # in each bin; chi-squared is the sum of squared counts over expected ones, less n.
    tokens = tokens.withColumn("widths", _of_encoding(F.array(*map(F.lit, _widths(k, COARSE))) for k in each))
    starts = ["n", *(f"from_{b}" for b in range(1, COARSE)), "0"]
    few = " + ".join(f"power({starts[b]} - {starts[b + 1]}, 2) / widths[{b}]" for b in range(COARSE))
    # A shift of the symbols' numbers to the codes of letters changes neither the serial correlation nor the power.
    tokens = tokens.withColumns({"z_few": F.expr(_normal(f"(({few}) * size / n - n)", str(COARSE))), "mean": F.expr("total / n")}).drop("widths", *starts[1:-1])
    tokens = tokens.withColumns({"lagged": F.expr("products - mean * (2 * total - ends) + (n - 1) * mean * mean"), "power": F.expr("squares - n * mean * mean")})
    tokens = tokens.withColumn("mu", F.expr("2D * low * (n - low) / n + 1"))
    tokens = tokens.withColumn("z_runs", F.expr("case when low = 0 or low = n or n < 3 then 9D else abs(runs - mu) / sqrt(greatest((mu - 1) * (mu - 2) / (n - 1), 1e-9)) end"))
    tokens = tokens.withColumn("z_lag", F.expr("case when power <= 1e-9 then 9D else abs(lagged / power + 1D / n) * sqrt(n) end"))
    tokens = tokens.drop("runs", "low", "total", "squares", "products", "ends", "mean", "lagged", "power", "mu")
    others = f"least(1 - {_cdf('z_few')}, 2 * (1 - {_cdf('z_runs')}), 2 * (1 - {_cdf('z_lag')}))"
    tokens = tokens.withColumns({"others": F.expr(others), "bins": F.expr("cast(greatest(2, least(size, n div 2)) as int)")}).drop("z_few", "z_runs", "z_lag")
    # Uniformity over many bins, which have one letter each; the counts are the lengths of replaced strings.  All choices
    # of bins stand in one array: methods of more than 8000 bytes, as with a case for each encoding, are not compiled by the JVM.
    by_bins = [(k, bins) for k in each for bins in range(2, sizes[k] + 1)]
    cut = F.array(*(F.struct(F.lit(_cells(k, bins, True)).alias("cells"), F.lit(_wide(k, bins)).alias("wide"), F.lit(min(_widths(k, bins))).alias("narrow")) for k, bins in by_bins))
    tokens = tokens.withColumn("cut", F.when(F.col("others") > 0, F.element_at(cut, _of_encoding(by_bins.index((k, 2)) - 1 for k in each) + F.col("bins"))))
    tokens = tokens.withColumns({"many": F.expr("translate(token, written, cut.cells)"), "wide": F.col("cut.wide"), "narrow": F.col("cut.narrow")}).drop("token", "written", "values", "cut")
    many = "aggregate(array_distinct(split(many, '')), 0D, (s, c) -> s + power(n - octet_length(replace(many, c, '')), 2) / if(c < wide, narrow, narrow + 1))"
    tokens = tokens.withColumn("z_many", F.expr(_normal(f"({many} * size / n - n)", "bins"))).drop("many", "wide", "narrow", "bins", "size")
    # A test that was not made is NULL, which _cdf() takes for the largest z; p is 0 there anyway.
    tokens = tokens.withColumns({"p": F.expr(f"least(1D, 4 * least(others, 1 - {_cdf('z_many')}))"), "stratum": F.expr("encoding * 64 + least(63, cast(2 * log2(n) as int))")})
    tokens = tokens.withColumn("far", F.expr("sqrt(-log10(greatest(p, 1e-19)))"))
    return tokens.drop("others", "z_many")


def text_pieces(texts: DataFrame) -> DataFrame:
    """Rows (encoding, token): the whole text of each row of ``texts`` (text, seed) outside candidates, in each encoding
    cut into pieces.  A text is cut into blocks and a block into pieces of one of ``LENGTHS``, which follow each other
    from block to block; the seed says which is the first.

    Characters beyond the alphabet are left out; words begin with a capital in base64, where names of things look so.
    Every other character is in one piece: a rest below ``SHORTEST`` goes to the piece before it, and only a text of
    fewer symbols gives none.  The cost is linear in the length of the text."""
    turn, letters = F.pmod(F.xxhash64("seed"), F.lit(len(LENGTHS))).cast("int"), F.regexp_replace(F.initcap("text"), CANDIDATE + r"|\P{Alnum}+", "")
    rows = texts.select(turn.alias("turn"), letters.alias("base64"))
    rows = rows.withColumns({"base32": F.upper(F.regexp_replace("base64", "[0189]+", "")), "hex": F.lower(F.regexp_replace("base64", "[G-Zg-z]+", ""))})
    rows = rows.withColumn("decimal", F.translate("hex", "abcdef", ""))
    written = rows.select("turn", F.posexplode(F.array(*(name for name, _, _ in ENCODINGS))).alias("encoding", "written"))
    blocks = written.select("turn", "encoding", F.posexplode(F.expr(f"regexp_extract_all(written, '.{{1,{BLOCK}}}(?:.{{1,{SHORTEST - 1}}}$)?', 0)")).alias("nr", "block"))
    length = F.element_at(F.array(*map(F.lit, LENGTHS)), F.pmod(F.col("turn") + F.col("nr"), F.lit(len(LENGTHS))) + 1)
    blocks = blocks.select("encoding", "block", F.char_length("block").alias("n"), length.alias("length")).filter(F.col("n") >= SHORTEST)
    blocks = blocks.withColumn("last", F.expr(f"cast((n - {SHORTEST}) div length as int)"))
    return blocks.select("encoding", F.explode(F.expr("transform(sequence(0, last), k -> substring(block, k * length + 1, if(k = last, n, length)))")).alias("token"))


def _prose(spark: SparkSession) -> DataFrame:
    """Texts (text, seed) that begin at each ``PROSE_STEP``-th place of ``PROSE`` and hold all of it."""
    places = spark.range(0, len(PROSE) - LONGEST, PROSE_STEP, numPartitions=1)
    return places.select(F.concat(F.substring(F.lit(PROSE), F.expr("cast(id as int)") + 1, F.lit(len(PROSE))), F.lit(" " + PROSE)).alias("text"), F.col("id").alias("seed"))


def text_moments(measured: DataFrame) -> dict[int, tuple[float, float]]:
    """For each stratum the mean and the deviation of ``far`` over pieces of text.

    A stratum without pieces takes the next shorter one of its encoding, as longer text
    looks less random still, or else the next longer one.  At most 4 * 64 rows come to the driver."""
    known = {r.stratum: (r.mean, max(LEAST_SPREAD, r.spread or 0.0)) for r in measured.groupBy("stratum").agg(F.avg("far").alias("mean"), F.stddev_samp("far").alias("spread")).collect()}
    out = {}
    for encoding in range(len(ENCODINGS)):
        own = sorted(s for s in known if s // 64 == encoding)
        for stratum in range(64 * encoding, 64 * encoding + 64) if own else ():
            out[stratum] = known[max((s for s in own if s <= stratum), default=own[0])]
    return out


def _by_stratum(values: dict[int, float], missing: float) -> Column:
    if not values:
        return F.lit(missing)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("stratum")), F.lit(missing))


def against_text(tested: DataFrame, moments: dict[int, tuple[float, float]]) -> DataFrame:
    """Adds p_text, the probability that text looks as random as the token, and its level; 1 in strata of unknown text."""
    z = (F.col("far") - _by_stratum({k: m for k, (m, _) in moments.items()}, -1e6)) / _by_stratum({k: s for k, (_, s) in moments.items()}, 1.0)
    return tested.withColumn("z", z).withColumn("p_text", F.expr(_cdf("z"))).drop("z").withColumn("level", F.expr(f"cast(least({LEVELS - 1}, floor(-{STEPS} * log10(greatest(p_text, 1e-19)))) as int)"))


def discovery_levels(tested: DataFrame, alpha: float = ALPHA) -> dict[int, int]:
    """For each stratum the level from which p_text is small enough to report a token.

    Level l holds p_text from 10^-((l + 1) / STEPS) to 10^-(l / STEPS).  The rule is Benjamini
    and Hochberg's on the upper edges: the smallest l with m * edge <= alpha * (tokens at
    l and above).  At most strata times LEVELS counts come to the driver."""
    counts: dict[int, list[int]] = {}
    for row in tested.groupBy("stratum", "level").count().collect():
        counts.setdefault(row["stratum"], [0] * LEVELS)[row["level"]] += row["count"]
    out = {}
    for stratum, held in counts.items():
        total, above = sum(held), 0
        out[stratum] = LEVELS
        for level in range(LEVELS - 1, -1, -1):
            above += held[level]
            if above and total * 10 ** (-level / STEPS) <= alpha * above:
                out[stratum] = level
    return out


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def scan(spark: SparkSession, docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Spans of secrets in every whole text of ``docs`` (doc_id, text); other columns are ignored, whatever their names.

    Returns doc_id, base and added: arrays of structs (start, rank, end, kind), code
    points, end exclusive, by start and then rank.  base holds assign, access and hex
    spans; added holds candidates outside them that pass the battery, of kind random.
    Null and empty texts have no spans, and an empty table gives none.  Repeated rows are
    scanned as often as they stand there; equal tokens have one verdict.  The cost of a
    text, and of a token of any length, is linear in its length.
    """
    found = places(docs)
    base = F.expr("sort_array(transform(concat(assign, access, hex), s -> named_struct('start', s.start, 'rank', s.rank, 'end', s.end, 'kind', s.kind)))")
    spans = found.select("doc_id", base.alias("base"), "maybe")
    outside = F.expr("filter(maybe, c -> not exists(base, b -> b.start < c.end and c.start < b.end))")
    spans = materialise(spark, spans.withColumn("key", F.monotonically_increasing_id()).withColumn("maybe", outside))

    open_ = spans.filter(F.size("maybe") > 0).select("key", F.explode("maybe").alias("c"))
    tokens = open_.select("key", "c.start", "c.end", F.xxhash64("c.body").alias("same"), _encoding(F.col("c.body")).alias("encoding"), F.col("c.body").alias("token"))
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id").alias("seed")).union(_prose(spark))
    judged = against_text(materialise(spark, battery(tokens)), text_moments(battery(text_pieces(texts))))
    levels = discovery_levels(judged.select("stratum", "level", "same", "n").distinct(), alpha)
    kept = judged.filter(F.col("level") >= _by_stratum(levels, LEVELS)).select("key", F.struct("start", F.lit(3).alias("rank"), "end", F.lit("random").alias("kind")).alias("s"))
    added = kept.groupBy("key").agg(F.sort_array(F.collect_list("s")).alias("added"))
    empty = F.expr("cast(array() as array<struct<start: int, rank: int, end: int, kind: string>>)")
    return spans.drop("maybe").join(added, "key", "left").select("doc_id", "base", F.coalesce("added", empty).alias("added"))


def report(spans: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, the digest of the base spans, and all spans as text."""
    count = {k: F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in ("assign", "access", "hex")}
    both = spans.withColumn("every", F.sort_array(F.concat("base", "added")))
    return both.select("doc_id", *count.values(), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("every").alias("spans"))
