"""Evaluation metrics: predictions derived from the statement log, gold is the logged statement."""

from pyspark.sql import functions as F

from bindings.registry import register
from bindings.sqltext import FEATURES
from bindings.statements import LOG, statement_log
from tidemark.functions import sqltext, tokens
from tidemark.operators import evaluation as ev


def scored(t):
    return ev.score(sqltext.with_complexity(statement_log(t), "sql"), "predicted", "sql")


def _tok(c):
    return f"list_filter(string_split_regex(regexp_replace(lower({c}), '([(),;])', ' \\1 ', 'g'), '\\s+'), lambda x: x <> '')"


_SETS = f"list_distinct({_tok('predicted')}) AS p, list_distinct({_tok('sql')}) AS g"
_EM = "CASE WHEN lower(regexp_replace(predicted, '^\\s+|\\s+$', '', 'g')) = lower(regexp_replace(sql, '^\\s+|\\s+$', '', 'g')) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_MICRO = "CASE WHEN len(g) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(p, g))::DOUBLE / len(list_distinct(list_concat(p, g))) END"
_DICE = "CASE WHEN len(g) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(p, g)) / (len(p) + len(g)) END"
SCORED = f"""(SELECT *, {_EM} AS exact_match, {_MICRO} AS f1_score, {_DICE} AS token_f1
  FROM (SELECT *, {_SETS} FROM {FEATURES} x) y)"""


@register("eval_exact_match", f"SELECT event_id, exact_match FROM {SCORED} z")
def _(t):
    return scored(t).select("event_id", "exact_match")


@register("eval_sql_tokens", f"SELECT event_id, array_to_string({_tok('sql')}, '|') AS tokens FROM ({LOG}) log")
def _(t):
    return statement_log(t).select("event_id", F.array_join(tokens.sql_tokens(F.col("sql")), "|").alias("tokens"))


@register("eval_token_f1_micro", f"SELECT event_id, f1_score FROM {SCORED} z", {"f1_score": 9})
def _(t):
    return scored(t).select("event_id", "f1_score")


@register("eval_token_f1_binary", f"SELECT event_id, token_f1 FROM {SCORED} z", {"token_f1": 9})
def _(t):
    return scored(t).select("event_id", "token_f1")


# Per step: pattern of the word, length of the suffix, letters that go, letters that come, test of what precedes the suffix.
# The first pattern of a step that matches decides.
_SHORT = "^([^aeiouy]*[aeiouy]*[^aeiouy][aeiouy][^aeiouywxY]|[aeiouy][^aeiouy])"
_ENDS = [
    [("^.ies$", 3, 1, "", ""), ("sses$", 4, 2, "", ""), ("ies$", 3, 2, "", ""), ("ss$", 2, 0, "", ""), ("s$", 1, 1, "", "")],
    [
        ("^.ied$", 3, 1, "", ""), ("ied$", 3, 2, "", ""), ("eed$", 3, 1, "", "M1"), ("(at|bl|iz)ed$", 2, 1, "", "V"),
        ("(at|bl|iz)ing$", 3, 3, "e", "V"), ("(ll|ss|zz)ed$", 2, 2, "", "V"), ("(ll|ss|zz)ing$", 3, 3, "", "V"),
        *[(f"{d}{d}{e}$", len(e), len(e) + 1, "", "V") for e in ("ed", "ing") for d in "bcdfghjkmnpqrtvwxY0123456789"],
        (_SHORT + "ed$", 2, 2, "e", "M=1"), ("ed$", 2, 2, "", "V"), (_SHORT + "ing$", 3, 3, "e", "M=1"), ("ing$", 3, 3, "", "V"),
    ],
    [(".[^aeiouy][yY]$", 1, 1, "i", "")],
    [("[aeiouy].*[^aeiouy].*alli$", 4, 2, "", "M1")],
    [
        ("ational$", 7, 5, "e", "M1"), ("tional$", 6, 2, "", "M1"), ("[ea]nci$", 4, 1, "e", "M1"), ("izer$", 4, 1, "", "M1"),
        ("bli$", 3, 1, "e", "M1"), ("entli$", 5, 2, "", "M1"), ("eli$", 3, 2, "", "M1"), ("ousli$", 5, 2, "", "M1"),
        ("ization$", 7, 5, "e", "M1"), ("ation$", 5, 3, "e", "M1"), ("ator$", 4, 2, "e", "M1"), ("alism$", 5, 3, "", "M1"),
        ("(iveness|fulness|ousness)$", 7, 4, "", "M1"), ("aliti$", 5, 3, "", "M1"), ("iviti$", 5, 3, "e", "M1"),
        ("biliti$", 6, 5, "le", "M1"), ("fulli$", 5, 2, "", "M1"), ("logi$", 3, 1, "", "M1"),
    ],
    [
        ("icate$", 5, 3, "", "M1"), ("ative$", 5, 5, "", "M1"), ("alize$", 5, 3, "", "M1"), ("iciti$", 5, 3, "", "M1"),
        ("ical$", 4, 2, "", "M1"), ("ful$", 3, 3, "", "M1"), ("ness$", 4, 4, "", "M1"),
    ],
    [
        ("ement$", 5, 5, "", "M2"), ("(ance|ence|able|ible|ment)$", 4, 4, "", "M2"), ("(ant|ent|ism|ate|iti|ous|ive|ize)$", 3, 3, "", "M2"),
        ("[st]ion$", 3, 3, "", "M2"), ("(al|er|ic|ou)$", 2, 2, "", "M2"),
    ],
    [("e$", 1, 1, "", "E")],
    [("ll$", 1, 1, "", "M2")],
]
_OWN = {"skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "innings": "inning", "outings": "outing", "cannings": "canning"} | {
    w: w for w in "sky news inning outing canning howe proceed exceed succeed".split()
}


def _stem_table(source):
    """Statements that give the table stems (word, stem) of the words of ``source`` (a column w)."""
    m1, m2, cvc = "^[^aeiouy]*[aeiouy]+[^aeiouy]", "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]", "[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$"
    out = [f"st0 AS (SELECT DISTINCT w, regexp_replace(w, '(^|[aeiouy])y', '\\1Y', 'g') AS s FROM {source})"]
    for i, step in enumerate(_ENDS):
        cases = []
        for pattern, n, less, more, test in step:
            rest = f"left(s, length(s) - {n})"
            ok = {
                "": "true", "M1": f"regexp_matches({rest}, '{m1}')", "M2": f"regexp_matches({rest}, '{m2}')", "V": f"regexp_matches({rest}, '[aeiouy]')",
                "M=1": f"regexp_matches({rest}, '[aeiouy]')",
                "E": f"(regexp_matches({rest}, '{m2}') OR (regexp_matches({rest}, '{m1}') AND NOT regexp_matches({rest}, '{cvc}')))",
            }[test]
            when = f"regexp_matches(s, '{pattern}')" + (f" AND regexp_matches({rest}, '{m1}') AND NOT regexp_matches({rest}, '{m2}')" if test == "M=1" else "")
            cases.append(f"WHEN {when} THEN CASE WHEN {ok} THEN left(s, length(s) - {less}) || '{more}' ELSE s END")
        out.append(f"st{i + 1} AS (SELECT w, CASE {' '.join(cases)} ELSE s END AS s FROM st{i})")
    own = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _OWN.items())
    out.append(f"stems AS (SELECT w, CASE WHEN length(w) <= 3 THEN w ELSE CASE w {own} ELSE lower(s) END END AS s FROM st{len(_ENDS)})")
    return ",\n    ".join(out)


def _words(c):
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def _stemmed(c):
    return f"list_transform({_words(c)}, lambda x: known[x])"


_TEXTS = f"""texts AS (SELECT event_id, predicted, sql FROM ({LOG}) log),
    spoken AS (SELECT unnest({_words('predicted')}) AS w FROM texts UNION SELECT unnest({_words('sql')}) FROM texts),
    {_stem_table('spoken')},
    dictionary AS (SELECT map(list(w), list(s)) AS known FROM stems),
    said AS (SELECT event_id, {_stemmed('predicted')} AS p, {_stemmed('sql')} AS g FROM texts, dictionary)"""


def _bigrams(w):
    return f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"


@register(
    "eval_rouge2",
    f"""WITH {_TEXTS},
    b AS (SELECT event_id, {_bigrams('p')} AS p, {_bigrams('g')} AS g FROM said),
    pc AS (SELECT event_id, k, count(*) AS n FROM (SELECT event_id, unnest(p) AS k FROM b) u GROUP BY ALL),
    gc AS (SELECT event_id, k, count(*) AS n FROM (SELECT event_id, unnest(g) AS k FROM b) u GROUP BY ALL),
    h AS (SELECT pc.event_id, sum(least(pc.n, gc.n)) AS hits FROM pc JOIN gc USING (event_id, k) GROUP BY pc.event_id),
    s AS (SELECT b.event_id, CASE WHEN len(p) = 0 THEN 0 ELSE coalesce(hits, 0)::DOUBLE / len(p) END AS pr,
      CASE WHEN len(g) = 0 THEN 0 ELSE coalesce(hits, 0)::DOUBLE / len(g) END AS re FROM b LEFT JOIN h ON h.event_id = b.event_id)
    SELECT event_id, pr AS rouge2_precision, re AS rouge2_recall, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS rouge2_fmeasure FROM s""",
    {"rouge2_precision": 9, "rouge2_recall": 9, "rouge2_fmeasure": 9},
)
def _(t):
    return ev.rouge2(statement_log(t), "event_id", "predicted", "sql")


# One step of the recursion adds one predicted word: a cell is the better of the cell above and one more than the best
# cell left of a match.
_STEP = """list_transform(range(1, len(g) + 1), lambda j: greatest(cells[j], coalesce(list_max(list_transform(range(1, j + 1),
  lambda i: CASE WHEN g[i] = p[k + 1] THEN CASE WHEN i = 1 THEN 1 ELSE cells[i - 1] + 1 END ELSE 0 END)), 0)))"""


@register(
    "eval_rouge_l",
    f"""WITH RECURSIVE {_TEXTS},
    w AS MATERIALIZED (SELECT * FROM said),
    u AS (SELECT DISTINCT p, g FROM w),
    dp AS (SELECT p, g, 0 AS k, list_transform(range(1, len(g) + 1), lambda j: 0::BIGINT) AS cells FROM u
      UNION ALL SELECT p, g, k + 1, {_STEP} FROM dp WHERE k < len(p)),
    l AS (SELECT p, g, CASE WHEN len(g) = 0 THEN 0 ELSE cells[len(g)] END AS hits FROM dp WHERE k = len(p)),
    s AS (SELECT event_id, CASE WHEN len(w.p) = 0 THEN 0 ELSE hits::DOUBLE / len(w.p) END AS pr, CASE WHEN len(w.g) = 0 THEN 0 ELSE hits::DOUBLE / len(w.g) END AS re
      FROM w JOIN l ON w.p = l.p AND w.g = l.g)
    SELECT event_id, pr AS rougel_precision, re AS rougel_recall, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS rougel_fmeasure FROM s""",
    {"rougel_precision": 9, "rougel_recall": 9, "rougel_fmeasure": 9},
)
def _(t):
    return ev.rouge_l(statement_log(t), "event_id", "predicted", "sql")


@register(
    "eval_overall",
    f"""SELECT count(*) AS n_rows, avg(exact_match) AS exact_match_mean, avg(f1_score) AS f1_score_mean, avg(token_f1) AS token_f1_mean FROM {SCORED} z""",
    {"exact_match_mean": 6, "f1_score_mean": 6, "token_f1_mean": 6},
)
def _(t):
    return ev.overall(scored(t), ["exact_match", "f1_score", "token_f1"])


@register(
    "eval_by_class",
    f"""SELECT primary_complexity, avg(f1_score) AS f1_score_mean, avg(exact_match) AS exact_match_mean, count(*) AS n_rows FROM {SCORED} z GROUP BY primary_complexity""",
    {"f1_score_mean": 6, "exact_match_mean": 6},
)
def _(t):
    return ev.by_class(scored(t), "primary_complexity")


@register(
    "eval_by_class_full",
    f"""SELECT primary_complexity, round(avg(exact_match), 4) AS exact_match_mean, round(stddev_samp(exact_match), 4) AS exact_match_std,
    count(*) AS exact_match_count, round(avg(token_f1), 4) AS token_f1_mean, round(stddev_samp(token_f1), 4) AS token_f1_std,
    count(*) AS token_f1_count FROM {SCORED} z GROUP BY primary_complexity""",
)
def _(t):
    return ev.by_class_full(scored(t), "primary_complexity", ["exact_match", "token_f1"])


@register(
    "eval_class_distribution",
    f"""SELECT primary_complexity, count(*) AS n_rows, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct FROM {FEATURES} x GROUP BY primary_complexity""",
)
def _(t):
    return ev.class_distribution(sqltext.with_complexity(statement_log(t), "sql"), "primary_complexity")


_MEANS = f"(SELECT primary_complexity AS c, avg(token_f1) AS m FROM {SCORED} z GROUP BY 1)"


@register(
    "eval_performance_gap",
    f"""WITH m AS {_MEANS}, b AS (SELECT * FROM m ORDER BY m DESC, c LIMIT 1), w AS (SELECT * FROM m ORDER BY m, c LIMIT 1)
    SELECT b.c AS best_class, b.m AS best, w.c AS worst_class, w.m AS worst, b.m - w.m AS gap, (b.m - w.m) / b.m AS relative_gap,
    b.m - w.m > 0.15 AS high_bias FROM b, w""",
    {"best": 6, "worst": 6, "gap": 6, "relative_gap": 6},
)
def _(t):
    return ev.performance_gap(scored(t), "primary_complexity", "token_f1")


@register(
    "eval_class_importance",
    f"""WITH m AS (SELECT c AS primary_complexity, round(m, 4) AS mean FROM {_MEANS} q)
    SELECT *, (avg(mean) OVER () - mean) * 100 AS importance FROM m""",
    {"importance": 6},
)
def _(t):
    return ev.class_importance(scored(t), "primary_complexity", "token_f1")


def validity_sql(c):
    body = f"regexp_replace(regexp_replace(upper(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '''[^'']*''', '''''', 'g'), '[\\s;]+$', '')"
    return f"""(CASE WHEN {c} IS NULL OR {body} = '' THEN 'EmptyStatement: nothing to run'
      WHEN NOT regexp_matches({body}, '^\\(*\\s*({'|'.join(sqltext.LEADING_WORDS)})\\b') THEN 'UnknownStatement: no known leading word'
      WHEN (len({body}) - len(replace({body}, '''', ''))) % 2 <> 0 THEN 'UnbalancedQuotes: a string is not closed'
      WHEN len(replace({body}, '(', '')) <> len(replace({body}, ')', '')) THEN 'UnbalancedBrackets: brackets do not match'
      WHEN regexp_matches({body}, '\\bSELECT\\s+(FROM|WHERE)\\b|\\bSELECT$') THEN 'EmptySelectList: nothing selected'
      WHEN regexp_matches({body}, '\\b(FROM|WHERE|JOIN|ON|BY|HAVING|AND|OR|SET|VALUES|LIMIT|UNION|IN)$|[,=<>(]$')
        THEN 'DanglingClause: the last clause has no operand' END)"""


@register(
    "eval_syntax_validity",
    f"""WITH v AS (SELECT primary_complexity, ({validity_sql('predicted')} IS NULL)::INT AS v FROM {FEATURES} x)
    SELECT 'overall' AS scope, sum(v)::BIGINT AS valid, count(*) AS n, round(avg(v), 4) AS validity FROM v
    UNION ALL SELECT primary_complexity, sum(v)::BIGINT, count(*), round(avg(v), 4) FROM v GROUP BY primary_complexity""",
)
def _(t):
    return ev.syntax_validity(sqltext.with_complexity(statement_log(t), "sql"), "predicted", "primary_complexity")


def _both_classes(t):
    gold = sqltext.with_complexity(statement_log(t), "sql").select("event_id", "predicted", F.col("primary_complexity").alias("gold_class"))
    return sqltext.with_complexity(gold, "predicted").select("event_id", "gold_class", F.col("primary_complexity").alias("guess"))


_PRED_FEATURES = FEATURES.replace(f"({LOG}) log", f"(SELECT event_id, predicted AS sql FROM ({LOG}) l0) log")
_CONF = f"""(SELECT g.primary_complexity AS gold_class, p.primary_complexity AS guess FROM {FEATURES} g JOIN {_PRED_FEATURES} p USING (event_id))"""


@register(
    "eval_confusion_matrix",
    f"SELECT gold_class AS true_class, guess AS predicted_class, count(*) AS n_rows FROM {_CONF} c GROUP BY ALL",
)
def _(t):
    return ev.confusion(_both_classes(t), "gold_class", "guess")


_CLASSES = [*sqltext.CLASS_SCORES, "unknown"]


@register(
    "eval_confusion_wide",
    f"""SELECT gold_class AS true_class, {', '.join(f"count(*) FILTER (guess = '{c}') AS {c}" for c in _CLASSES)} FROM {_CONF} c GROUP BY gold_class""",
)
def _(t):
    return ev.confusion_matrix(_both_classes(t), "gold_class", "guess", _CLASSES)


@register(
    "eval_class_report",
    f"""WITH c AS (SELECT * FROM {_CONF} q), k AS (SELECT gold_class AS cls FROM c UNION SELECT guess FROM c),
    s AS (SELECT cls, (SELECT count(*) FROM c WHERE gold_class = cls) AS support, (SELECT count(*) FROM c WHERE guess = cls) AS named,
      (SELECT count(*) FROM c WHERE guess = cls AND gold_class = cls) AS hits FROM k)
    SELECT cls, support, CASE WHEN named = 0 THEN 0 ELSE hits::DOUBLE / named END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits::DOUBLE / support END AS recall,
    CASE WHEN hits = 0 THEN 0 ELSE 2.0::DOUBLE * hits / (named + support) END AS f1 FROM s""",
    {"precision": 9, "recall": 9, "f1": 9},
)
def _(t):
    return ev.class_report(_both_classes(t), "gold_class", "guess")


@register(
    "eval_param_correlation",
    """SELECT 'l_quantity' AS param, corr(l_quantity, l_extendedprice) AS correlation FROM lineitem
    UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice) FROM lineitem
    UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem""",
    {"correlation": 6},
)
def _(t):
    return ev.param_correlation(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
