"""Secret scans with a random forest against false positives.  DataFrame functions only.

Candidates are long runs of key-like characters, passwords in addresses (``scheme://user:password@``), and whatever stands as the value
after a key word and an assignment or quote: any characters but blanks, in quotes also blanks.  Each is described by native
expressions: length, kinds of characters and the transitions between them, how much of it a dictionary explains, whether it is part of a
path or address, and the words before it.  The dictionary is the corpus itself: words that stand in at least ``WORD_SHARE`` of all
documents (and in ``FEWEST``), kept in a filter of a fixed size.  The forest is grown on labelled findings (a bounded sample whose bound is a parameter)
and compiled into nested CASE expressions, so scoring is one projection beside the text, without Python on the executors.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import rows
from lexiloom.llm.rows import OPEN, SHUT, let
from lexiloom.llm.tables import bounded_sample

MIN_LENGTH, TREES, DEPTH, MAX_FINDINGS, CUT = 12, 25, 8, 4000, 0.5
MIN_VALUE = 4  # after a key word
#: A word of the dictionary stands in so many documents; slots of its filter, two for each word.
WORD_SHARE, FEWEST, SLOTS = 1e-3, 3, 1 << 20

_RUN = rf"[A-Za-z0-9_+/.-]{{{MIN_LENGTH},}}+(?:={{1,2}}(?![A-Za-z0-9_+/.=-]))?"

#: Words that come before a secret, words of placeholders, pieces of ordinary identifiers, and how public services begin their keys.
KEY_WORDS = "api apikey auth authorization bearer credential key passphrase passwd password private pwd secret token access"
PLACEHOLDERS = "changeme dummy example fake foo placeholder sample test todo xxxx your"
PLAIN_WORDS = "sha1 sha256 md5 commit checksum hash digest revision uuid guid etag id version build file path image url see page"
DICTIONARY = "able account after api app base class client code com config content data date default doc docs file from home html http https image index info item line list local main model name net number order page part path project public query request response server service set site source state string system table test text time type user util value version view web word work www"
PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ github_pat_ glpat- sk_live_ sk_test_ rk_live_ pk_live_ xoxb- xoxp- xoxa- AIza ya29. npm_ pypi- SG. hf_ dop_v1_ eyJ"

FEATURES = ["length", "digits", "upper", "lower", "symbols", "transitions", "hex_only", "distinct", "dictionary", "known_words", "longest_letters", "vowels", "slashes", "dots", "key_word", "plain_word", "placeholder", "assigned", "quoted", "prefixed", "in_address", "dashes", "date_like", "reference"]


def _any_of(words: str) -> str:
    return "(?:" + "|".join(w.replace(".", r"\.") for w in words.split()) + ")"


#: A key word with an assignment or an opening quote after it, and the value there: a run that ends with the value, a quoted
#: text without such runs, or non-blank characters up to closing punctuation.
KEYED = rf"(?:(?<![a-z])|(?=[A-Z]))(?i:{_any_of(KEY_WORDS)})[A-Za-z0-9_-]{{0,8}}+(?:[\"']?\s{{0,4}}(?::=|=>|[=:])\s{{0,4}}[\"']?|\s{{1,4}}[\"'])"
_QUOTED = "|".join(rf"(?<={q})(?![^{q}\r\n]*[A-Za-z0-9_+/.-]{{{MIN_LENGTH}}})[^{q}\r\n]{{{MIN_VALUE},}}+(?={q})" for q in "\"'")
_VALUE = rf"{_RUN}(?=[\s\"',;&)\]}}]|$)|{_QUOTED}|[^\s\"']{{{MIN_VALUE - 1},}}[^\s\"',;.)\]}}]"
#: The user of an address and what stands between it and the host.
ADDRESS = r"://[A-Za-z0-9._%+-]{0,64}:"
_PASSWORD = rf"(?<=[A-Za-z0-9._%+-]:)[^\s/@\"':]{{{MIN_VALUE},128}}+(?=@[A-Za-z0-9])"
CANDIDATE = rf"({KEYED}|{ADDRESS}(?={_PASSWORD}))({_PASSWORD}|{_VALUE})|(?<![A-Za-z0-9_+/.-])({_RUN})"


def _letters(text: Column) -> Column:
    """Runs of three letters or more, in lower case; a change of case ends one."""
    return F.regexp_extract_all(F.regexp_replace(text, "(?<=[a-z])(?=[A-Z])", " "), F.lit("[A-Za-z]{3,}"), F.lit(0))


def corpus_words(docs: DataFrame) -> Column | None:
    """The dictionary as a filter of ``SLOTS`` bytes; None if there is none.

    The words of a share of all documents are at most (words of a document) / ``WORD_SHARE`` many; each task's are counted before the
    shuffle.
    """
    n = docs.count()
    least = max(FEWEST, WORD_SHARE * n)
    words = docs.select(F.explode(F.array_distinct(F.transform(_letters(F.col("text").cast("string")), lambda w: F.lower(w)))).alias("w"))
    often = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    held = bytearray(SLOTS)
    for at in often.select(F.explode(F.array(*_slots(F.col("w")))).alias("at")).distinct().toArrow()["at"].to_pylist():  # at most SLOTS numbers
        held[at] = 1
    return F.lit(held) if any(held) else None


def _slots(w: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(w, F.lit(k)), F.lit(SLOTS)).cast("int") for k in range(2)]


def _known(words: Column | None, w: Column) -> Column:
    if words is None:
        return F.lit(False)
    one = F.lit(bytearray(b"\x01"))
    a, b = (F.substring(words, at + 1, F.lit(1)) == one for at in _slots(F.lower(w)))
    return a & b


def describe(value: Column, before: Column, after: Column, words: Column | None = None) -> dict[str, Column]:
    """The features of a candidate from its text, up to 40 characters before and 2 after, and the dictionary."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda cls: F.regexp_count(value, F.lit(cls)) / n
    low, near = F.lower(value), F.lower(before)
    letters = F.aggregate(F.split(value, r"[^A-Za-z]+"), F.lit(0), lambda a, w: F.greatest(a, F.length(w)))
    explained = F.length(F.array_join(F.regexp_extract_all(low, F.lit(_any_of(DICTIONARY)), F.lit(0)), ""))
    known = F.aggregate(F.filter(_letters(value), lambda w: _known(words, w)), F.lit(0), lambda a, w: a + F.length(w))
    return {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "transitions": F.regexp_count(value, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")) / n,
        "hex_only": value.rlike("^[0-9a-fA-F]+$").cast("double"),
        "distinct": F.size(F.array_distinct(F.split(low, ""))) / n,
        "dictionary": explained / n,
        "known_words": known / n,
        "longest_letters": letters.cast("double"),
        "vowels": share("[aeiouAEIOU]"),
        "slashes": F.regexp_count(value, F.lit("/")).cast("double"),
        "dots": F.regexp_count(value, F.lit(r"\.")).cast("double"),
        "key_word": near.rlike(rf"(?<![a-z]){_any_of(KEY_WORDS)}[a-z_]{{0,8}}[^a-z]{{0,6}}$").cast("double"),
        "plain_word": near.rlike(rf"(?<![a-z]){_any_of(PLAIN_WORDS)}[^a-z]{{0,6}}$").cast("double"),
        "placeholder": low.rlike(_any_of(PLACEHOLDERS)).cast("double"),
        "assigned": before.rlike(r"[=:]\s*[\"']?$").cast("double"),
        "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
        "prefixed": value.rlike(rf"^{_any_of(PREFIXES)}[A-Za-z0-9_.-]{{12,}}").cast("double"),
        "in_address": (before.rlike(rf"{ADDRESS}$") & after.rlike("^@")).cast("double"),
        "dashes": F.regexp_count(value, F.lit("-")).cast("double"),
        "date_like": value.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|v?[0-9]+\.[0-9]+\.)").cast("double"),
        "reference": value.rlike(r"^(?:[$<{(%*]|process\.|os\.|env\.|self\.|config\.)|\(\)?$").cast("double"),
    }


def built_in_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled findings (before, value, after, label): twenty kinds of secrets against twenty-four of what is mistaken for them, each kind from a
    plain description of its form, in the places where it stands.  The same rows at every call."""
    rng = random.Random(17)
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    low, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    up, b64 = low.upper(), low + low.upper() + digit
    tongue = ["ther", "ing", "ation", "ever", "ance", "light", "stone", "water", "under", "press", "form", "ment", "corn", "hat", "river", "summer", "dragon", "monkey", "tiger", "blue"]
    word, name = lambda: rng.choice(tongue), lambda: rng.choice(DICTIONARY.split())
    cap = lambda: word().capitalize()
    secrets = [
        lambda: some(hexa, rng.choice([32, 40, 64])), lambda: some(hexa, rng.randint(9, 20)), lambda: some(b64, rng.randint(20, 44)), lambda: some(b64 + "+/", rng.choice([24, 43])) + "=" * rng.randint(0, 2),
        lambda: rng.choice(["AKIA", "ASIA"]) + some(up + digit, 16), lambda: rng.choice(["ghp_", "gho_", "glpat-", "npm_", "hf_"]) + some(b64, rng.randint(20, 36)), lambda: rng.choice(["sk_live_", "rk_live_", "sk_test_"]) + some(b64, 24),
        lambda: rng.choice(["xoxb-", "xoxp-"]) + some(digit, 12) + "-" + some(digit, 12) + "-" + some(b64, 24), lambda: "AIza" + some(b64 + "_-", 35), lambda: "SG." + some(b64, 22) + "." + some(b64, 43),
        lambda: "eyJ" + some(b64, 33) + "." + "eyJ" + some(b64, 40) + "." + some(b64 + "_-", 43), lambda: word() + some(digit, rng.randint(1, 4)) + some("!@#$%&*?", rng.randint(1, 2)),
        lambda: cap() + some(digit, rng.randint(2, 4)) + some("!@#$%&*", rng.randint(0, 2)), lambda: some(b64 + "!@#$%&*?", rng.randint(8, 16)), lambda: word().replace("e", "3").replace("o", "0") + rng.choice("#!$-") + word() + rng.choice("!9#") + some(digit, 1),
        lambda: " ".join(word() for _ in range(4)), lambda: some(low, rng.randint(14, 20)), lambda: some(up, rng.randint(14, 20)), lambda: some(up + "234567", rng.choice([16, 32])), lambda: "-".join(word() for _ in range(4)) + some(digit, 2),
    ]
    naked = {0, 2, 3, 4, 5, 6, 7, 8, 9, 10}  # kinds that are known for secrets without a key word
    dull = [
        lambda: some(hexa, rng.choice([32, 40, 64])), lambda: "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: "/" + "/".join(name() for _ in range(rng.randint(2, 4))) + rng.choice(["", "/index.html", ".py", ".json"]), lambda: "_".join(name() for _ in range(3)),
        lambda: "".join(name().capitalize() for _ in range(4)), lambda: name() + "".join(name().capitalize() for _ in range(3)), lambda: "".join(word() for _ in range(4)), lambda: f"your_{name()}_here", lambda: ".".join(["www", word() + word(), "com"]), lambda: ".".join(name() for _ in range(4)),
        lambda: f"20{some(digit, 2)}-0{rng.randint(1, 9)}-1{some(digit, 1)}T{some('01', 1)}1:{some('12345', 1)}4:00", lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 40)}.{rng.randint(0, 9)}-{rng.choice(['beta', 'rc', 'alpha'])}.{rng.randint(1, 9)}", lambda: rng.choice(["0", "978-", "ISBN-", "ORD-", "INV-20"]) + some(digit, 12), lambda: some(digit, rng.randint(12, 16)),
        lambda: "sha512-" + some(b64 + "+/", 60), lambda: "/".join([word(), word() + "-" + word(), some(digit, 4)]), lambda: "-".join(word() for _ in range(4)), lambda: rng.choice(["required", "none", "null", "true", "string", "value", "empty", "missing", "optional", "default", "hidden", "below", "other", "first", "false", "undefined", "enter", "forgotten"]),
        lambda: word() + rng.choice(["", "er", "ing", "ed"]), lambda: rng.choice(["${%s}", "<%s>", "{{%s}}", "$%s", "%%(%s)s"]) % "_".join([name(), rng.choice(["token", "key", "secret"])]).upper(), lambda: rng.choice(["process.env.", "os.environ.", "config.", "self."]) + name() + "_" + name(), lambda: rng.choice("*x.") * rng.randint(6, 12), lambda: f"{name()}-example-{some(digit, 4)}", lambda: name() + "_" + name() + "(" + name() + ")",
    ]
    keyed_dull = {7, 17, 18, 19, 20, 21, 22, 23}  # what stands after a key word and is no secret
    out = []
    for i in range(n):
        label, kind = i % 2, rng.randrange(len(secrets) if i % 2 else len(dull))
        value = (secrets if label else dull)[kind]()
        key = "and then " + rng.choice(["", "my ", "db_", "the "]) + rng.choice(["token", "password", "api_key", "secret", "auth_token", "ACCESS_KEY", "private_key", "pwd", "passwd", "Authorization", "client_secret", "API_KEY"]) + rng.choice([" = ", "=", ": ", ":", ' = "', "='", '": "', " = '", ' := "'])
        plain = "and then " + rng.choice(["commit ", "sha256 ", "md5: ", "see ", "file ", "id: ", "checksum = ", "the ", "of ", "version ", "etag: ", 'id="', "from ", "on ", "integrity=", "src=\"", "uuid "])
        loose = "and then " + rng.choice(["the ", "use ", "with ", "curl -H ", "it was ", "export X=", '"', "(", "login "])
        if label and kind in (11, 12, 13, 14, 18) and rng.random() < 0.25 and not set(value) & set("@/:"):
            before, after = rng.choice(["postgres://admin:", "https://user:", "redis://:", "mysql://root:", "amqp://app:"]), "@h"
        elif label:
            before = loose if kind in naked - {0, 2, 3} and rng.random() < 0.4 else key
            after = rng.choice([" a", ", ", "\n"])
        else:
            before = key if kind in keyed_dull else plain if rng.random() < 0.85 or kind in (0, 1, 14) else loose
            after = rng.choice([" a", ", ", ". "])
        if before[-1] in "\"'":
            after = before[-1] + rng.choice([" ", ",", "\n"])
        out.append((before[-40:], value, after[:2], label))
    return spark.createDataFrame(out, "before string, value string, after string, label int")


class Forest:
    """Bagged trees on Gini impurity; each split looks at a random third of the features."""

    def __init__(self, rows_: list[list[float]], labels: list[int], trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> None:
        rng = random.Random(seed)
        self.trees = []
        if rows_:
            for _ in range(trees):
                bag = [rng.randrange(len(rows_)) for _ in rows_]
                self.trees.append(self._grow([rows_[i] for i in bag], [labels[i] for i in bag], depth, rng))

    def _grow(self, rows_, labels, depth, rng):
        rate = sum(labels) / len(labels)
        if not depth or rate in (0.0, 1.0) or len(labels) < 8:
            return rate
        best = None
        for f in rng.sample(range(len(rows_[0])), max(1, len(rows_[0]) // 3)):
            order = sorted(zip((r[f] for r in rows_), labels, strict=True))
            left_n = left_p = 0
            total = sum(labels)
            for i in range(len(order) - 1):
                left_n, left_p = left_n + 1, left_p + order[i][1]
                if order[i][0] == order[i + 1][0]:
                    continue
                right_n, right_p = len(order) - left_n, total - left_p
                gini = left_p * (left_n - left_p) / left_n + right_p * (right_n - right_p) / right_n
                if best is None or gini < best[0]:
                    best = (gini, f, (order[i][0] + order[i + 1][0]) / 2)
        if best is None:
            return rate
        _, f, at = best
        sides = [[i for i, r in enumerate(rows_) if (r[f] <= at) == side] for side in (True, False)]
        return (f, at, *(self._grow([rows_[i] for i in s], [labels[i] for i in s], depth - 1, rng) for s in sides))

    def column(self, x: Column) -> Column:
        """Mean vote as an expression over a struct of the features."""

        def branch(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            f, at, low, high = node
            return F.when(x[FEATURES[f]] <= at, branch(low)).otherwise(branch(high))

        if not self.trees:
            return F.lit(0.0)
        total = branch(self.trees[0])
        for tree in self.trees[1:]:
            total = total + branch(tree)
        return total / len(self.trees)


def train(findings: DataFrame, words: Column | None = None, max_findings: int = MAX_FINDINGS) -> Forest:
    """Forest from labelled findings (before, value, after, label), of at most ``max_findings`` by hash order, and the corpus's dictionary."""
    cols = describe(F.coalesce("value", F.lit("")), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), words)
    sample = bounded_sample(findings.where("label is not null"), ["before", "value", "after"], max_findings)
    found = sample.select(F.xxhash64("before", "value", "after").alias("h"), "label", *[cols[f].cast("double").alias(f) for f in FEATURES]).collect()
    found = sorted(found)[:max_findings]
    return Forest([[r[f] for f in FEATURES] for r in found], [int(r["label"]) for r in found])


def find_secrets(docs: DataFrame, forest: Forest, words: Column | None = None, cut: float = CUT) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (start:end, code points), score (largest vote) of every row.

    A candidate is a run of at least ``MIN_LENGTH`` key characters with a digit or a change of case inside, a password in an address, or a
    value of at least ``MIN_VALUE`` characters of any kind after a key word.  Null and empty texts have none; texts of any length are
    searched whole; null and repeated ids keep their rows; other columns are ignored; an empty table gives an empty result.
    """
    shape = "array<struct<start:int,value:string,before:string,after:string>>"

    def place(p: Column) -> Column:
        def one(at: Column) -> Column:
            def here(piece: Column, i: Column) -> Column:
                previous = F.replace(F.get(p, i), F.lit(SHUT), F.lit(""))
                return F.struct(F.get(at, i).cast("int").alias("start"), rows.matched(piece).alias("value"), F.right(previous, F.lit(40)).alias("before"), F.left(rows.rest(piece), F.lit(2)).alias("after"))

            found = F.transform(F.slice(p, F.lit(2), F.size(p)), here)
            return F.filter(found, lambda c: c["value"].rlike("[0-9]|[a-z][A-Z]") | c["before"].rlike(f"(?:{KEYED}|{ADDRESS})$"))

        return let(rows.starts(p), one)

    cut_ = let(rows.unmarked(F.col("text")), lambda t: rows.pieces(t, CANDIDATE, f"$1{OPEN}$2$3{SHUT}"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(cut_, lambda p: F.when(F.size(p) > 1, place(p)).otherwise(F.array().cast(shape))).alias("c"))

    def judged(c: Column) -> Column:
        x = F.struct(*[v.cast("double").alias(k) for k, v in describe(c["value"], c["before"], c["after"], words).items()])
        vote = let(x, forest.column)
        return F.struct(c["start"].alias("start"), (c["start"] + F.length(c["value"])).alias("end"), vote.alias("vote"))

    scored = found.select("doc_id", F.transform("c", judged).alias("c"))
    hits = F.filter("c", lambda s: s["vote"] >= cut)
    return scored.select(
        "doc_id",
        F.size("c").cast("long").alias("n_candidates"),
        F.size(hits).cast("long").alias("n_secrets"),
        F.array_join(F.transform(hits, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("secrets"),
        F.round(F.coalesce(F.array_max(F.transform("c", lambda s: s["vote"])), F.lit(0.0)), 6).alias("score"),
    )
