"""DuckDB SQL for the registered queries, from common table expressions that build on one another."""

from __future__ import annotations

from subspark.functions.text import PRETOKEN
from subspark.plans.fixtures import LONGEST, VOCABULARY

CTES = {
    "lines": "SELECT doc_id, lang, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents)",
    "toks": r"SELECT doc_id, line_no, unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM (SELECT doc_id, line_no, regexp_extract_all(line, '\S+') AS ts FROM lines)",
    "pretoks": f"SELECT doc_id, lang, line_no, unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM (SELECT *, regexp_extract_all('▁' || replace(line, ' ', '▁'), '{PRETOKEN}') AS ts FROM lines)",
    "counted": "SELECT token AS word, count(*)::BIGINT AS n FROM toks GROUP BY token",
    "words": "SELECT id::INT AS id, word, n, embedding::DOUBLE[] AS vec FROM (SELECT *, row_number() OVER (ORDER BY n DESC, word) - 1 AS id FROM counted) JOIN embeddings ON vec_id = id",
    "vocab": f"SELECT id::INT AS id, word, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, word) - 1 AS id FROM counted) WHERE id < {VOCABULARY}",
    "vedges": f"SELECT word, n, b - 1 AS s, substr(word, b, l) AS piece FROM (SELECT *, unnest(range(1, length(word) - l + 2)) AS b FROM (SELECT *, unnest(range(1, least(length(word), {LONGEST}) + 1)) AS l FROM vocab))",
    "size": "SELECT count(*) AS v FROM embeddings",
    "edges": f"SELECT word, id, n, vec, b - 1 AS s, substr(word, b, l) AS piece FROM (SELECT *, unnest(range(1, length(word) - l + 2)) AS b FROM (SELECT *, unnest(range(1, least(length(word), {LONGEST}) + 1)) AS l FROM words))",
    "subs": "SELECT piece AS subword, (row_number() OVER (ORDER BY piece) - 1)::INT AS id FROM (SELECT DISTINCT piece FROM edges)",
    "near3": "SELECT a.doc_id, a.token AS word, b.token AS context FROM toks a JOIN toks b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 3",
    "near1": "SELECT a.doc_id, a.token AS word, b.token AS context FROM toks a JOIN toks b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND abs(a.pos - b.pos) = 1",
    "vcooc": "SELECT a.id AS row_id, b.id AS col_id, count(*)::BIGINT AS n FROM near3 JOIN vocab a ON near3.word = a.word JOIN vocab b ON near3.context = b.word GROUP BY ALL",
    "cooc3": "SELECT a.id AS row_id, b.id AS col_id, count(*)::BIGINT AS n FROM near3 JOIN words a ON near3.word = a.word JOIN words b ON near3.context = b.word GROUP BY ALL",
    "stats": "SELECT piece AS subword, col_id, sum(k * c.n)::BIGINT AS n FROM (SELECT id, piece, count(*) AS k FROM edges GROUP BY ALL) e JOIN cooc3 c ON e.id = c.row_id GROUP BY ALL",
    "proj": "SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings",
    "sums": "SELECT dim, sum(x) AS column_sum FROM proj GROUP BY dim",
    "totals": "SELECT subword, sum(n) AS total FROM stats GROUP BY subword",
    "emb": "SELECT s.subword, sums.dim, (ln(1e-5) - ln(coalesce(total, 0) + v * 1e-5)) * column_sum + coalesce(added, 0) AS x FROM subs s CROSS JOIN sums CROSS JOIN size LEFT JOIN totals t ON s.subword = t.subword LEFT JOIN (SELECT subword, dim, sum((ln(n + 1e-5) - ln(1e-5)) * x) AS added FROM stats JOIN proj ON col_id = id GROUP BY ALL) a ON s.subword = a.subword AND sums.dim = a.dim",
    "tedges": f"SELECT word, n, b - 1 AS s, substr(word, b, l) AS piece FROM (SELECT *, unnest(range(1, length(word) - l + 2)) AS b FROM (SELECT *, unnest(range(1, least(length(word), {LONGEST}) + 1)) AS l FROM counted))",
    "psubs": "SELECT piece AS subword, (row_number() OVER (ORDER BY piece) - 1)::BIGINT AS id FROM (SELECT DISTINCT piece FROM tedges)",
    "sc": "SELECT piece, round(ln(n / sum(n) OVER ()), 9) AS score FROM (SELECT piece, sum(n)::BIGINT AS n FROM tedges GROUP BY piece)",
    "wsc": "SELECT piece, max(score) AS score FROM (SELECT piece, score FROM sc UNION ALL (SELECT '##' || piece, round(score - 0.5, 9) FROM sc)) GROUP BY piece",
    "pv": "SELECT subword AS piece, embedding::DOUBLE[] AS vec FROM subs JOIN embeddings ON vec_id = subs.id % (SELECT v FROM size)",
    "cos": "SELECT DISTINCT w.word, e.piece, list_cosine_similarity(w.vec, pv.vec) - 1 AS score FROM words w JOIN edges e ON w.word = e.word JOIN pv ON e.piece = pv.piece",
}
NEEDS = {
    "toks": ["lines"], "pretoks": ["lines"], "counted": ["toks"], "words": ["counted"], "edges": ["words"], "subs": ["edges"], "near3": ["toks"],
    "near1": ["toks"], "vocab": ["counted"], "vedges": ["vocab"], "vcooc": ["near3", "vocab"], "cooc3": ["near3", "words"], "stats": ["edges", "cooc3"], "sums": ["proj"], "totals": ["stats"], "emb": ["subs", "sums", "size", "totals", "proj"],
    "tedges": ["counted"], "psubs": ["tedges"], "sc": ["tedges"], "wsc": ["sc"], "pv": ["subs", "size"], "cos": ["edges", "pv"],
}


def _dp(spans: str, joined: str, start: str, prefix: str, words: str = "counted") -> dict[str, str]:
    """Tables of a segmentation of all words, or of those with vectors: spans (word, s, e, score, piece) -> steps, back, {prefix}seg (word, pieces, score)."""
    return {
        f"{prefix}spans": spans,
        f"{prefix}dp": f"SELECT word, 0 AS i, [{start}::DOUBLE] AS c, [0] AS p FROM {words} UNION ALL SELECT d.word, d.i + 1, list_append(d.c, coalesce(max(b).c, -1000)), list_append(d.p, coalesce(-max(b).p, d.i)) FROM (SELECT d.word, d.i, d.c, d.p, CASE WHEN s.s IS NULL THEN NULL ELSE {{'c': round({joined}, 9), 'p': -s.s::INT}} END AS b FROM {prefix}dp d LEFT JOIN {prefix}spans s ON s.word = d.word AND s.e = d.i + 1 WHERE d.i < length(d.word)) d GROUP BY d.word, d.i, d.c, d.p",
        f"{prefix}back": f"SELECT word, i AS loc, c[i + 1] AS score, p, []::VARCHAR[] AS out, i AS n FROM {prefix}dp WHERE i = length(word) UNION ALL SELECT word, p[loc + 1], score, p, list_prepend(substr(word, p[loc + 1] + 1, loc - p[loc + 1]), out), n FROM {prefix}back WHERE loc > 0",
        f"{prefix}seg": f"SELECT b.word, w.n, out AS pieces, score FROM {prefix}back b JOIN {words} w ON b.word = w.word WHERE loc = 0",
    }


SEGMENTED = {
    "": _dp("SELECT e.word, s, s + length(e.piece) AS e, score FROM tedges e JOIN sc ON e.piece = sc.piece", "d.c[s.s + 1] + s.score", "0", ""),
    "m": _dp("SELECT e.word, s, s + length(e.piece) AS e, score FROM tedges e JOIN sc ON e.piece = sc.piece", "least(d.c[s.s + 1], s.score)", "1e9", "m"),
    "w": _dp("SELECT e.word, s, s + length(e.piece) AS e, score FROM tedges e JOIN wsc ON wsc.piece = CASE WHEN s > 0 THEN '##' ELSE '' END || e.piece", "d.c[s.s + 1] + s.score", "0", "w"),
    "c": _dp("SELECT e.word, s, s + length(e.piece) AS e, coalesce(score, CASE WHEN length(e.piece) = 1 THEN -2 END) AS score FROM edges e LEFT JOIN cos ON e.word = cos.word AND e.piece = cos.piece WHERE score IS NOT NULL OR length(e.piece) = 1", "d.c[s.s + 1] + s.score", "0", "c", "words"),
}
#: Each piece cut by its own vector, without itself; a position that no piece reaches counts as before.
CTES |= {
    "rspans": "SELECT a.piece AS word, s, s + l AS e, list_cosine_similarity(a.vec, b.vec) - 1 AS score FROM (SELECT piece, vec, l, unnest(range(length(piece) - l + 1)) AS s FROM (SELECT piece, vec, unnest(range(1, length(piece) + 1)) AS l FROM pv)) a JOIN pv b ON b.piece = substr(a.piece, s + 1, l) AND b.piece <> a.piece",
    "rdp": "SELECT piece AS word, 0 AS i, [0.0::DOUBLE] AS c, [0] AS p FROM pv UNION ALL SELECT d.word, d.i + 1, list_append(d.c, coalesce(max(b).c, -1000)), list_append(d.p, coalesce(-max(b).p, d.i)) FROM (SELECT d.word, d.i, d.c, d.p, CASE WHEN s.s IS NULL THEN NULL ELSE {'c': round(d.c[s.s + 1] + s.score, 9), 'p': -s.s::INT} END AS b FROM rdp d LEFT JOIN rspans s ON s.word = d.word AND s.e = d.i + 1 WHERE d.i < length(d.word)) d GROUP BY d.word, d.i, d.c, d.p",
    "rback": "SELECT word, i AS loc, p, []::VARCHAR[] AS out FROM rdp WHERE i = length(word) UNION ALL SELECT word, p[loc + 1], p, list_prepend(substr(word, p[loc + 1] + 1, loc - p[loc + 1]), out) FROM rback WHERE loc > 0",
    "rparts": "SELECT word, out, unnest(out) AS piece FROM rback WHERE loc = 0 AND len(out) > 1",
    "rmean": "SELECT word, out, list(x ORDER BY dim) AS mean FROM (SELECT word, out, dim, avg(x) AS x FROM (SELECT word, out, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM rparts JOIN pv ON rparts.piece = pv.piece) GROUP BY ALL) GROUP BY ALL",
}
NEEDS |= {"rspans": ["pv"], "rdp": ["pv", "rspans"], "rback": ["rdp"], "rparts": ["rback"], "rmean": ["rparts", "pv"]}
SEGMENTED["e"] = _dp("SELECT e.word, s, s + length(e.piece) AS e, list_cosine_similarity(e.vec, v.vec) - 1 AS score FROM edges e JOIN evec v ON e.piece = v.piece", "d.c[s.s + 1] + s.score", "0", "e", "words")
CTES["evec"] = "SELECT subword AS piece, list(x ORDER BY dim) AS vec FROM emb GROUP BY subword"
NEEDS["evec"] = ["emb"]
for prefix, made in SEGMENTED.items():
    CTES |= made
    rows, pieces, scores = {"c": ("words", "edges", "cos"), "e": ("words", "edges", "evec"), "w": ("counted", "tedges", "wsc")}.get(prefix, ("counted", "tedges", "sc"))
    NEEDS |= {f"{prefix}spans": [pieces, scores], f"{prefix}dp": [rows, f"{prefix}spans"], f"{prefix}back": [f"{prefix}dp"], f"{prefix}seg": [f"{prefix}back", rows]}
CTES |= {
    "uni": "SELECT token, sum(n)::BIGINT AS n FROM (SELECT unnest(pieces) AS token, n FROM seg UNION ALL SELECT '<w>', n FROM seg) GROUP BY token",
    "pairs": "SELECT list_prepend('<w>', pieces) AS a, n FROM seg",
    "bi": "SELECT prev, token, sum(n)::BIGINT AS n FROM (SELECT unnest(a[:-2]) AS prev, unnest(a[2:]) AS token, n FROM pairs) GROUP BY ALL",
    "bib": "SELECT CASE prev WHEN '<w>' THEN '###' ELSE prev END AS prev, token, n FROM bi",
    "nv": "SELECT count(*) AS nv FROM psubs",
    "lm0": "SELECT prev, token, ln(n) - ln(sum(n) OVER (PARTITION BY prev) + nv) AS logp, -ln(sum(n) OVER (PARTITION BY prev) + nv) AS default_logp FROM bib, nv",
    "lm1": "SELECT prev, token, ln(n + 1) - ln(sum(n) OVER (PARTITION BY prev) + nv) AS logp, -ln(sum(n) OVER (PARTITION BY prev) + nv) AS default_logp FROM bib, nv",
    "ctx": f"SELECT piece AS subword, context AS word, sum(k * n)::BIGINT AS n FROM (SELECT word, context, count(*) AS n FROM near3 WHERE context IN (SELECT word FROM words) GROUP BY ALL) p JOIN (SELECT word, piece, count(*) AS k FROM (SELECT word, substr(word, b, l) AS piece FROM (SELECT word, l, unnest(range(1, length(word) - l + 2)) AS b FROM (SELECT word, unnest(range(1, least(length(word), {LONGEST}) + 1)) AS l FROM counted))) GROUP BY ALL) e USING (word) WHERE piece IN (SELECT subword FROM subs) GROUP BY ALL",
    "halves": "SELECT * FROM ctx",
    "lmr": "SELECT prev, token, round(logp, 6) AS logp FROM lm1",
    # cells of pieces by where they end: (start, end, piece, score, start of the piece before); equal scores take the smallest start
    "cells": f"SELECT word, 0 AS i, [{{'s': 0, 'e': 0, 't': '###', 'v': 0.0::DOUBLE, 'k': 0}}] AS c FROM counted UNION ALL SELECT word, i + 1, list_concat(c, coalesce(list(one) FILTER (WHERE one IS NOT NULL), [])) FROM (SELECT word, i, c, CASE WHEN max(b) IS NOT NULL THEN {{'s': e, 'e': i + 1, 't': substr(word, e + 1, i + 1 - e), 'v': max(b).v, 'k': -max(b).n}} END AS one FROM (SELECT a.word, a.i, a.c, a.x.e AS e, CASE WHEN logp IS NOT NULL THEN {{'v': round(a.x.v + logp, 9), 'n': -a.x.s}} END AS b FROM (SELECT word, i, c, unnest(c) AS x FROM cells WHERE i < length(word)) a LEFT JOIN lmr ON prev = a.x.t AND token = substr(a.word, a.x.e + 1, a.i + 1 - a.x.e) WHERE a.x.e > a.i - {LONGEST} OR a.x.e = 0) GROUP BY word, i, c, e) GROUP BY word, i, c",
    "lasts": "SELECT word, c, list_filter(c, lambda x: x.e = length(word)) AS ended FROM cells WHERE i = length(word)",
    "trace": "SELECT word, c, list_sort(list_transform(ended, lambda x: {'v': x.v, 'n': -x.s, 'x': x}), 'DESC')[1].x AS x, []::VARCHAR[] AS out, NULL::DOUBLE AS score FROM lasts WHERE len(ended) > 0 UNION ALL SELECT word, c, CASE WHEN x.s > 0 THEN list_filter(c, lambda y: y.e = x.s AND y.s = x.k)[1] END, list_prepend(x.t, out), coalesce(score, x.v) FROM trace WHERE x IS NOT NULL",
    "best": "SELECT w.word, coalesce(out, [w.word]) AS pieces, score FROM counted w LEFT JOIN (SELECT * FROM trace WHERE x IS NULL) p ON w.word = p.word",
    "gstep": f"SELECT word, 0 AS loc, '###' AS prev, []::VARCHAR[] AS out, 0.0::DOUBLE AS score FROM counted UNION ALL SELECT word, loc + length(b.t), b.t, list_append(out, b.t), score + b.p FROM (SELECT word, loc, prev, out, score, coalesce(max(CASE WHEN token IS NOT NULL THEN {{'r': logp / length(token), 'n': -length(token), 't': token, 'p': logp}} END), {{'r': 0.0, 'n': 0, 't': substr(word, loc + 1, 1), 'p': 0.0}}) AS b FROM (SELECT g.*, token, logp FROM (SELECT *, unnest(range(1, {LONGEST} + 1)) AS l FROM gstep WHERE loc < length(word)) g LEFT JOIN lmr ON lmr.prev = g.prev AND token = substr(g.word, g.loc + 1, g.l) AND length(token) = g.l) GROUP BY word, loc, prev, out, score)",
    # sums of exp(score) over the segmentations of each prefix, and of each suffix by its length
    "fwd": "SELECT word, 0 AS i, [1.0::DOUBLE] AS a FROM counted UNION ALL SELECT word, i + 1, list_append(a, coalesce(sum(y), 0)) FROM (SELECT f.word, f.i, f.a, f.a[s.s + 1] * exp(s.score) AS y FROM fwd f LEFT JOIN spans s ON s.word = f.word AND s.e = f.i + 1 WHERE f.i < length(f.word)) GROUP BY word, i, a",
    "bwd": "SELECT word, 0 AS i, [1.0::DOUBLE] AS a FROM counted UNION ALL SELECT word, i + 1, list_append(a, coalesce(sum(y), 0)) FROM (SELECT f.word, f.i, f.a, f.a[length(f.word) - s.e + 1] * exp(s.score) AS y FROM bwd f LEFT JOIN spans s ON s.word = f.word AND s.s = length(f.word) - f.i - 1 WHERE f.i < length(f.word)) GROUP BY word, i, a",
    "expected": "SELECT f.word, substr(f.word, s.s + 1, s.e - s.s) AS piece, sum(f.a[s.s + 1] * exp(s.score) * b.a[length(f.word) - s.e + 1]) AS x FROM fwd f JOIN bwd b ON f.word = b.word AND f.i = length(f.word) AND b.i = length(f.word) JOIN spans s ON s.word = f.word GROUP BY ALL",
}
NEEDS |= {
    "uni": ["seg"], "pairs": ["seg"], "bi": ["pairs"], "bib": ["bi"], "nv": ["psubs"], "lm0": ["bib", "nv"], "lm1": ["bib", "nv"], "ctx": ["near3", "words", "subs", "counted"],
    "halves": ["ctx"], "lmr": ["lm1"], "cells": ["counted", "lmr"], "lasts": ["cells"], "trace": ["lasts"], "best": ["trace", "counted"], "gstep": ["counted", "lmr"],
    "fwd": ["counted", "spans"], "bwd": ["counted", "spans"], "expected": ["fwd", "bwd"],
}


def with_(names: str, select: str) -> str:
    order: list[str] = []

    def add(name):
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" if "UNION ALL SELECT" not in CTES[n] or n == "uni" else f"{n} AS ({CTES[n]})" for n in order) + " " + select


def _ngrams(source: str, order: int, strict: bool = False) -> str:
    last = f"least({order}, length(word) - i + 1)" if strict else f"{order}"
    return f"SELECT substr(word, i, l) AS ngram, sum(n)::BIGINT AS n FROM (SELECT word, n, i, unnest(range(1, {last} + 1)) AS l FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM {source})) GROUP BY 1"


PRE = "(SELECT token AS word, count(*) AS n FROM pretoks GROUP BY 1)"
SEG = "SELECT word, n, array_to_string(pieces, ' ') AS pieces, round(score, 6) + 0.0 AS score FROM "
ORACLES = {
    "pretok_vocab": with_("pretoks", "SELECT token, count(*)::BIGINT AS n FROM pretoks GROUP BY token"),
    "pretok_vocab_by_lang": with_("pretoks", "SELECT lang, token, count(*)::BIGINT AS n FROM pretoks GROUP BY ALL"),
    "pretok_tokens": with_("pretoks", "SELECT doc_id, line_no, pos, token FROM pretoks"),
    "ws_word_counts": with_("counted", "SELECT * FROM counted"),
    "word_freq_invocab": with_("vocab", "SELECT w.word, count(t.token)::BIGINT AS n FROM vocab w LEFT JOIN toks t ON w.word = t.token GROUP BY w.word"),
    "ngram_corpus": with_("pretoks", _ngrams(PRE, 4)),
    "ngram_strict": with_("pretoks", _ngrams(PRE, 4, True)),
    "ngram_vocab_weighted": with_("counted", _ngrams("counted", 8)),
    "ngram_distinct": with_("pretoks", f"SELECT ngram FROM ({_ngrams(PRE, 4)})"),
    "substrings_of_vocab": with_("vedges", "SELECT word, piece, count(*)::BIGINT AS n FROM vedges GROUP BY ALL"),
    "substrings_invocab": with_("vedges subs", "SELECT word, s AS start, piece, subs.id FROM vedges JOIN subs ON piece = subword"),
    "substrings_wordpiece": with_("vedges", "SELECT word, s AS start, CASE WHEN s > 0 THEN '##' ELSE '' END || piece AS piece FROM vedges"),
    "substrings_excluded": with_("vedges subs", "SELECT word, s AS start, piece FROM vedges LEFT JOIN subs ON piece = subword WHERE subs.id IS NULL OR subs.id % 3 <> 0"),
    "cooc_word_word": with_("vcooc", "SELECT * FROM vcooc"),
    "cooc_window_1": with_("near1 vocab", "SELECT a.id AS row_id, b.id AS col_id, count(*)::BIGINT AS n FROM near1 JOIN vocab a ON near1.word = a.word JOIN vocab b ON near1.context = b.word GROUP BY ALL"),
    "context_subword_word": with_("ctx", "SELECT * FROM ctx"),
    "context_filtered": with_("ctx", "SELECT * FROM ctx WHERE subword IN (SELECT subword FROM ctx GROUP BY subword HAVING length(subword) = 1 OR (count(*) >= 3 AND sum(n) >= 50))"),
    "merge_contexts_sum": with_("halves", "SELECT * FROM halves"),
    "merge_contexts_filtered": with_("halves", "SELECT * FROM halves WHERE subword IN (SELECT subword FROM halves GROUP BY subword HAVING length(subword) = 1 OR (count(*) >= 2 AND sum(n) >= 20))"),
    "concat_embeddings": with_("words pv", "SELECT word, dim::INT AS dim, round(x, 6) + 0.0 AS x, shard FROM (SELECT word, unnest(range(len(vec))) AS dim, unnest(vec) AS x, 0 AS shard FROM words UNION ALL SELECT piece, unnest(range(len(vec))), unnest(vec), 1 FROM pv)"),
    "allowed_edges_inverse": with_("vedges", "SELECT piece AS subword, count(*)::BIGINT AS n_edges, count(DISTINCT word)::BIGINT AS n_words FROM vedges GROUP BY piece"),
    "weighted_edges": with_("vedges", "SELECT piece AS subword, word, sum(n)::BIGINT AS n FROM vedges GROUP BY ALL"),
    "subword_cooc": with_("stats", "SELECT * FROM stats"),
    "row_lognorm": with_("stats size", "SELECT subword, col_id, round(ln(n + 1e-5) - ln(sum(n) OVER (PARTITION BY subword) + v * 1e-5), 6) + 0.0 AS log_share, round(ln(1e-5) - ln(sum(n) OVER (PARTITION BY subword) + v * 1e-5), 6) + 0.0 AS log_rest FROM stats, size"),
    "subword_embeddings": with_("emb", "SELECT subword, dim, round(x, 6) + 0.0 AS x FROM emb"),
    "word_subword_cosine": with_("cos", "SELECT word, piece, round(score, 6) + 0.0 AS score FROM cos"),
    "mean_vector_fallback": with_("words", "SELECT word, dim::INT AS dim, round(x, 6) + 0.0 AS x FROM (SELECT word, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM words UNION ALL SELECT 'no such word', dim, avg(x) FROM (SELECT unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM words) GROUP BY dim)"),
    "viterbi_sum": with_("seg", SEG + "seg"),
    "viterbi_maxmin": with_("mseg", SEG + "mseg"),
    "viterbi_wordpiece": with_("wseg", "SELECT word, array_to_string(list_prepend(pieces[1], list_transform(pieces[2:], lambda x: '##' || x)), ' ') AS pieces, round(score, 6) + 0.0 AS score FROM wseg"),
    "viterbi_cosine": with_("cseg", "SELECT word, array_to_string(pieces, ' ') AS pieces, round(score, 6) + 0.0 AS score FROM cseg"),
    "subword_redundancy": with_("rmean pv", "SELECT word AS piece, array_to_string(out, ' ') AS pieces, round(1 - list_cosine_similarity(vec, mean), 6) + 0.0 AS score FROM rmean JOIN pv ON word = piece"),
    "subword_frequency": with_("seg", "SELECT piece, sum(n)::BIGINT AS n FROM (SELECT unnest(list_distinct(pieces)) AS piece, n FROM seg) GROUP BY piece"),
    "subword_remove_bottom_k": with_("seg", "SELECT piece, sum(n)::BIGINT AS n FROM (SELECT unnest(list_distinct(pieces)) AS piece, n FROM seg) WHERE length(piece) > 1 GROUP BY piece ORDER BY n, piece LIMIT 50"),
    "unigram_stats": with_("uni psubs", "SELECT subword AS token, coalesce(n, 0)::BIGINT AS n FROM psubs LEFT JOIN uni ON subword = token"),
    "bigram_stats": with_("bi", "SELECT * FROM bi"),
    "next_edges": with_("seg", "SELECT subword, word, count(*)::BIGINT AS n FROM (SELECT unnest(pieces) AS subword, word FROM seg) GROUP BY ALL"),
    "pruned_vocab": with_("seg psubs", "SELECT subword FROM psubs WHERE subword IN (SELECT unnest(pieces) FROM seg)"),
    "bigram_lm_mle": with_("lm0", "SELECT prev, token, round(logp, 6) + 0.0 AS logp, round(default_logp, 6) + 0.0 AS default_logp FROM lm0"),
    "bigram_lm_addone": with_("lm1", "SELECT prev, token, round(logp, 6) + 0.0 AS logp, round(default_logp, 6) + 0.0 AS default_logp FROM lm1"),
    "bigram_score_backoff": with_("uni bi", "SELECT q.prev, q.token, round(CASE WHEN a.n IS NOT NULL THEN ln((coalesce(bi.n, 0) + 1) / a.n) WHEN b.n IS NOT NULL THEN ln(b.n / t) ELSE -ln(t) END, 6) + 0.0 AS score FROM (SELECT prev, token FROM bi UNION SELECT prev || '?', token FROM bi UNION SELECT prev, token || '?' FROM bi UNION SELECT 'no', 'none') q LEFT JOIN uni a ON a.token = q.prev LEFT JOIN uni b ON b.token = q.token LEFT JOIN bi ON bi.prev = q.prev AND bi.token = q.token, (SELECT sum(n) AS t FROM uni)"),
    "posterior_scores": with_("lm1", "SELECT token, round(ln(sum(exp(logp))), 6) + 0.0 AS score FROM lm1 GROUP BY token"),
    "reduced_vocab": with_("lmr psubs", "SELECT id, subword AS token FROM psubs WHERE subword NOT IN (SELECT subword FROM psubs LEFT JOIN (SELECT token, max(logp) + ln(sum(exp(logp - m))) AS score FROM (SELECT *, max(logp) OVER (PARTITION BY token) AS m FROM lmr) GROUP BY token) ON token = subword WHERE length(subword) > 1 AND subword <> '###' ORDER BY round(coalesce(score, -1e300), 9), subword LIMIT 300)"),
    "expected_counts": with_("expected", "SELECT word, piece, round(x / sum(x) OVER (PARTITION BY word), 6) + 0.0 AS share FROM expected WHERE x > 0"),
    "em_epoch_segmentations": with_("eseg", SEG + "eseg"),
    "bigram_viterbi_words": with_("best", "SELECT word, array_to_string(pieces, ' ') AS pieces, round(score, 6) + 0.0 AS score FROM best"),
    "greedy_words": with_("gstep", "SELECT word, array_to_string(out, ' ') AS pieces, round(round(score, 9), 6) + 0.0 AS score FROM gstep WHERE loc = length(word)"),
}
