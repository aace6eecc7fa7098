"""SQL (DuckDB dialect) spellings of the operators, for the correctness oracles.

Every fragment mirrors one DataFrame operator; both read the same driver
tables and use the same md5 keys, so results must be equal row for row.
"""

from __future__ import annotations

from shotlab.config import Params
from shotlab.functions.hashing import sql_hkey, sql_hnum
from shotlab.functions.stopwords import ENGLISH
from shotlab.functions.text import PIECE_PATTERN, WORD_PATTERN, WHITESPACE_RUN
from shotlab.operators.vocab import ROUNDS, WALK
from shotlab.sources.labelled import LANGS, LENGTH_EDGES, SPLIT_DIGIT
from shotlab.sources.registry import task as get_task, word_lists


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def split_expr(col: str) -> str:
    return f"CASE WHEN substr(md5('split|' || CAST({col} AS VARCHAR)), 1, 1) < '{SPLIT_DIGIT}' THEN 'train' ELSE 'test' END"


def lab_sql(name: str) -> str:
    t = get_task(name)
    sp = split_expr("d.doc_id")
    if t.key in ("sst2", "CR"):
        col = "quality" if t.key == "sst2" else "toxic"
        return (f"SELECT d.doc_id, d.text, CAST(l.{col} AS INTEGER) AS label_idx, {sp} AS split "
                f"FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
    if t.key == "ag":
        langs = ", ".join(q(x) for x in LANGS)
        return (f"SELECT d.doc_id, d.text, CAST(list_position([{langs}], d.lang) - 1 AS INTEGER) AS label_idx, "
                f"{sp} AS split FROM documents d WHERE d.lang IN ({langs})")
    if t.key in ("sst5", "sst3"):
        lab = " + ".join(["0"] + [f"CAST(d.n_chars >= {e} AS INTEGER)" for e in LENGTH_EDGES])
        if t.key == "sst3":
            lab = f"floor(({lab}) / 1.5)"
        return f"SELECT d.doc_id, d.text, CAST({lab} AS INTEGER) AS label_idx, {sp} AS split FROM documents d"
    if t.key == "dbpedia":
        num = r"regexp_extract(d.source, '^src(\d+)$', 1)"
        return (f"SELECT * FROM (SELECT d.doc_id, d.text, CASE WHEN {num} <> '' THEN CAST({num} AS INTEGER) % {len(t.labels)} END "
                f"AS label_idx, {sp} AS split FROM documents d) WHERE label_idx IS NOT NULL")
    raise ValueError(name)


def reps_sql(p: Params) -> str:
    return f"SELECT CAST(range AS INTEGER) AS rep FROM range({p.repeats})"


def sample_sql(p: Params) -> str:
    """Needs CTEs ``lab`` and ``reps``; gives (rep, split, pos, doc_id, label_idx)."""
    h = sql_hkey(p.seed, "sample", "r.rep", "l.doc_id")
    return (f"SELECT rep, split, pos, doc_id, label_idx FROM ("
            f"SELECT r.rep, l.split, l.doc_id, l.label_idx, CAST(row_number() OVER "
            f"(PARTITION BY r.rep, l.split ORDER BY {h}, l.doc_id) - 1 AS INTEGER) AS pos "
            f"FROM lab l CROSS JOIN reps r) "
            f"WHERE pos < CASE WHEN split = 'train' THEN {p.pool_num} ELSE {p.test_num} END")


def vocab_sql(pattern: str = WORD_PATTERN) -> str:
    return f"SELECT DISTINCT unnest(regexp_extract_all(text, '{pattern}')) AS token FROM documents"


def lmap_ctes(p: Params, strict: bool = True) -> str:
    """CTEs ``lorg``, ``lw``, ``lmap`` (needs ``reps``)."""
    t = get_task(p.task)
    vals = ", ".join(f"({i}, {q(w)})" for i, w in enumerate(t.labels))
    out = [f"lorg AS (SELECT * FROM (VALUES {vals}) v(label_idx, label_org))"]
    kind, lists = word_lists(t, p.pattern, strict)
    if kind == "original":
        out.append("lw AS (SELECT r.rep, o.label_idx, o.label_org AS label_word FROM lorg o CROSS JOIN reps r)")
    elif kind in ("fixed", "lists"):
        wv = ", ".join(f"({ci}, {wi}, {q(w)})" for ci, ws in enumerate(lists) for wi, w in enumerate(ws))
        h = sql_hkey(p.seed, "label_word", "r.rep", "w.label_idx", "w.word_pos")
        out.append(f"lwords AS (SELECT * FROM (VALUES {wv}) v(label_idx, word_pos, word))")
        out.append(f"lw AS (SELECT r.rep, w.label_idx, arg_min(w.word, {h}) AS label_word "
                   f"FROM lwords w CROSS JOIN reps r GROUP BY r.rep, w.label_idx)")
    else:
        h = sql_hkey(p.seed, "label_token", "r.rep", "c.label_idx", "v.token")
        out.append(f"vocab AS ({vocab_sql()})")
        out.append(f"lw AS (SELECT r.rep, c.label_idx, arg_min(v.token, {h}) AS label_word FROM vocab v "
                   f"CROSS JOIN reps r CROSS JOIN (SELECT CAST(range AS INTEGER) AS label_idx FROM range({t.n_labels})) c "
                   f"GROUP BY r.rep, c.label_idx)")
    out.append(f"lmap AS (SELECT w.rep, {q(t.key)} AS task, w.label_idx, w.label_word, o.label_org "
               f"FROM lw w JOIN lorg o ON o.label_idx = w.label_idx)")
    out.append("mi AS (SELECT rep, label_word, CAST(min(label_idx) AS INTEGER) AS merged_idx FROM lmap GROUP BY rep, label_word)")
    return ",\n".join(out)


def base_ctes(p: Params) -> str:
    """lab, reps, smp, lmap, mi, vs (verbalised sample)."""
    return (f"WITH lab AS ({lab_sql(p.task)}),\nreps AS ({reps_sql(p)}),\nsmp AS ({sample_sql(p)}),\n"
            f"{lmap_ctes(p)},\n"
            f"vs AS (SELECT s.rep, s.split, s.pos, s.doc_id, s.label_idx, m.label_word FROM smp s "
            f"JOIN lmap m ON m.rep = s.rep AND m.label_idx = s.label_idx)")


def texts_ctes(p: Params) -> str:
    """pool / tst: sample rows with text (memo: original label word)."""
    if "memo_label" in p.pattern:
        txt = ("(SELECT o.label_org FROM mi JOIN lmap o ON o.rep = mi.rep AND o.label_idx = mi.merged_idx "
               "WHERE mi.rep = s.rep AND mi.label_word = s.label_word)")
        src = f"SELECT s.*, {txt} AS text FROM vs s"
    elif p.pattern == "token":
        return (f"{perm_ctes(p)},\n"
                f"prot AS (SELECT DISTINCT rep, unnest(regexp_extract_all(label_word, '{PIECE_PATTERN}')) AS token FROM lmap UNION "
                f"SELECT r.rep, t.token FROM reps r CROSS JOIN (SELECT unnest(regexp_extract_all({q(get_task(p.task).prompt_x)}, '{PIECE_PATTERN}')) AS token "
                f"UNION SELECT unnest(regexp_extract_all({q(get_task(p.task).prompt_y)}, '{PIECE_PATTERN}'))) t),\n"
                f"pm AS (SELECT p.* FROM perm p WHERE NOT EXISTS (SELECT 1 FROM prot WHERE prot.rep = p.rep AND prot.token = p.token)),\n"
                f"dtok AS (SELECT s.rep, s.doc_id, unnest(regexp_extract_all(d.text, '{PIECE_PATTERN}')) AS token, "
                f"unnest(generate_series(1, len(regexp_extract_all(d.text, '{PIECE_PATTERN}')))) AS i FROM vs s JOIN documents d ON d.doc_id = s.doc_id),\n"
                f"ptext AS (SELECT k.rep, k.doc_id, string_agg(coalesce(pm.new_token, k.token), '' ORDER BY k.i) AS text FROM dtok k "
                f"LEFT JOIN pm ON pm.rep = k.rep AND pm.token = k.token GROUP BY k.rep, k.doc_id),\n"
                f"vt AS (SELECT s.*, coalesce(x.text, '') AS text FROM vs s LEFT JOIN ptext x ON x.rep = s.rep AND x.doc_id = s.doc_id),\n"
                f"pool AS (SELECT * FROM vt WHERE split = 'train'),\ntst AS (SELECT * FROM vt WHERE split = 'test')")
    else:
        src = "SELECT s.*, d.text FROM vs s JOIN documents d ON d.doc_id = s.doc_id"
    return (f"vt AS ({src}),\npool AS (SELECT * FROM vt WHERE split = 'train'),\n"
            f"tst AS (SELECT * FROM vt WHERE split = 'test')")


def demos_cte(p: Params) -> str:
    n, k = p.pool_num, p.k
    if k == 0:
        return "dem AS (SELECT rep, doc_id AS test_id, 0 AS ord, 0 AS train_pos FROM vs WHERE false)"
    t = f"({sql_hnum(p.seed, 'demo', 's.rep', 's.doc_id', 'j')} % (j + 1))"
    floyd = (f"list_reduce(generate_series({n - k}, {n - 1}), lambda acc, j: CASE WHEN list_contains(acc, {t}) "
             f"THEN list_append(acc, j) ELSE list_append(acc, {t}) END, CAST([] AS BIGINT[]))")
    h = sql_hkey(p.seed, "demo_order", "rep", "test_id", "train_pos")
    return (f"dr AS (SELECT s.rep, s.doc_id AS test_id, {floyd} AS d FROM vs s WHERE s.split = 'test'),\n"
            f"du AS (SELECT rep, test_id, CAST(unnest(d) AS INTEGER) AS train_pos FROM dr),\n"
            f"dem AS (SELECT rep, test_id, CAST(row_number() OVER (PARTITION BY rep, test_id ORDER BY {h}, train_pos) - 1 "
            f"AS INTEGER) AS ord, train_pos FROM du)")


def prompts_ctes(p: Params) -> str:
    t = get_task(p.task)
    px, py = q(t.prompt_x), q(t.prompt_y)
    return (f"pieces AS (SELECT m.rep, m.test_id, m.ord, {px} || pl.text || {py} || pl.label_word AS piece "
            f"FROM dem m JOIN pool pl ON pl.rep = m.rep AND pl.pos = m.train_pos),\n"
            f"dtx AS (SELECT rep, test_id, string_agg(piece, '' ORDER BY ord) AS demo_text FROM pieces GROUP BY rep, test_id),\n"
            f"prompts AS (SELECT t.rep, t.doc_id AS test_id, t.label_word AS gold_word, "
            f"coalesce(x.demo_text, '') || {px} || t.text || {py} AS prompt FROM tst t "
            f"LEFT JOIN dtx x ON x.rep = t.rep AND x.test_id = t.doc_id)")


def norm_sql(col: str) -> str:
    return f"strip_accents(lower({col}))"


def tokset_sql(col: str) -> str:
    return f"list_distinct(regexp_extract_all({norm_sql(col)}, '{WORD_PATTERN}'))"


def scores_ctes(p: Params) -> str:
    inter = "len(list_intersect(q.toks, d.toks))"
    uni = f"(len(q.toks) + len(d.toks) - {inter})"
    return (f"tok AS (SELECT rep, doc_id, {tokset_sql('text')} AS toks FROM vt),\n"
            f"pairs AS (SELECT m.rep, m.test_id, pl.label_word, CASE WHEN {uni} = 0 THEN 0.0 ELSE {inter} / {uni} END AS jac "
            f"FROM dem m JOIN pool pl ON pl.rep = m.rep AND pl.pos = m.train_pos "
            f"JOIN tok q ON q.rep = m.rep AND q.doc_id = m.test_id JOIN tok d ON d.rep = m.rep AND d.doc_id = pl.doc_id),\n"
            f"sums AS (SELECT rep, test_id, label_word, sum(jac) AS s FROM pairs GROUP BY rep, test_id, label_word),\n"
            f"scores AS (SELECT t.rep, t.doc_id AS test_id, l.label_idx, round(coalesce(x.s, 0.0), 9) AS score "
            f"FROM tst t JOIN lmap l ON l.rep = t.rep "
            f"LEFT JOIN sums x ON x.rep = t.rep AND x.test_id = t.doc_id AND x.label_word = l.label_word),\n"
            f"gold AS (SELECT t.rep, t.doc_id AS test_id, mi.merged_idx AS gold_idx FROM tst t "
            f"JOIN mi ON mi.rep = t.rep AND mi.label_word = t.label_word),\n"
            f"pr AS (SELECT s.rep, s.test_id, g.gold_idx, first(s.label_idx ORDER BY s.score DESC, s.label_idx) AS pred_idx, "
            f"CAST(1 + count(*) FILTER (WHERE s.score > gs.score) AS INTEGER) AS gold_rank FROM scores s "
            f"JOIN gold g ON g.rep = s.rep AND g.test_id = s.test_id "
            f"JOIN scores gs ON gs.rep = s.rep AND gs.test_id = s.test_id AND gs.label_idx = g.gold_idx "
            f"GROUP BY s.rep, s.test_id, g.gold_idx)")


def f1_cte(src: str = "pr", by: str = "rep", name: str = "f1") -> str:
    return (f"{name}_e AS (SELECT {by}, gold_idx AS cls_, 1 AS g_, 0 AS p_, CAST(gold_idx = pred_idx AS INTEGER) AS tp_ "
            f"FROM {src} UNION ALL SELECT {by}, pred_idx AS cls_, 0 AS g_, 1 AS p_, 0 AS tp_ FROM {src}),\n"
            f"{name}_c AS (SELECT {by}, cls_, sum(g_) AS ng, sum(p_) AS np, sum(tp_) AS tp FROM {name}_e GROUP BY {by}, cls_),\n"
            f"{name} AS (SELECT {by}, avg(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (ng + np) END) AS macro_f1 "
            f"FROM {name}_c GROUP BY {by})")


def stop_list_sql() -> str:
    return "[" + ", ".join(q(w) for w in ENGLISH) + "]"


WS_RUN = WHITESPACE_RUN


def doc_grams_cte(src: str, key: str, ngc_max: int, ngw_max: int, name: str = "grams") -> str:
    """``name``(key, block, n, term, cnt) over the rows of ``src`` (which has ``text``): one row per
    character or token with those that follow it in its window, counted for each n by itself."""
    norm = norm_sql("text")
    cells = {"char": f"list_filter(string_split(regexp_replace({norm}, '{WS_RUN}', ' ', 'g'), ''), lambda x: x <> '')",
             "word": f"list_filter(regexp_extract_all({norm}, '{WORD_PATTERN}'), lambda x: NOT list_contains({stop_list_sql()}, x))"}
    ctes, parts = [], []
    for block, top, gap in (("char", ngc_max, "''"), ("word", ngw_max, "' '")):
        if not top:
            continue
        nexts = ", ".join(f"{' || '.join(['u'] + [f'{gap} || lead(u, {k}) OVER w' for k in range(1, n)])} AS t{n}" for n in range(1, top + 1))
        ctes.append(f"{name}_{block}u AS (SELECT {key}, unnest(x) AS u, generate_subscripts(x, 1) AS i FROM (SELECT {key}, {cells[block]} AS x FROM {src}))")
        ctes.append(f"{name}_{block} AS (SELECT {key}, {nexts} FROM {name}_{block}u WINDOW w AS (PARTITION BY {key} ORDER BY i))")
        parts += [f"SELECT {key}, '{block}' AS block, {n} AS n, t{n} AS term, count(*) AS cnt FROM {name}_{block} WHERE t{n} IS NOT NULL GROUP BY {key}, t{n}" for n in range(1, top + 1)]
    return ",\n".join(ctes) + f",\n{name} AS ({' UNION ALL '.join(parts)})"


def baseline_ctes(p: Params, attempts: int = 64) -> str:
    """Attempts 0..attempts are enough for the registered parameters (a missing replicate would
    show as missing rows). bs, bpool, btest, need, att, cd, cls, ch, fit (needs base_ctes)."""
    h = sql_hkey(p.seed, "coverage", "p.rep", "a.attempt", "p.pos")
    return (f"bs AS (SELECT v.*, mi.merged_idx FROM vs v JOIN mi ON mi.rep = v.rep AND mi.label_word = v.label_word),\n"
            f"bpool AS (SELECT rep, pos, doc_id, merged_idx AS label_idx FROM bs WHERE split = 'train'),\n"
            f"btest AS (SELECT rep, doc_id, merged_idx AS y FROM bs WHERE split = 'test'),\n"
            f"need AS (SELECT rep, count(DISTINCT y) AS n_classes FROM btest GROUP BY rep),\n"
            f"att AS (SELECT CAST(range AS INTEGER) AS attempt FROM range(0, {attempts + 1})),\n"
            f"cd AS (SELECT * FROM (SELECT p.rep, a.attempt, p.pos, p.doc_id, p.label_idx, row_number() OVER "
            f"(PARTITION BY p.rep, a.attempt ORDER BY CASE WHEN a.attempt = 0 THEN lpad(CAST(p.pos AS VARCHAR), 8, '0') "
            f"ELSE {h} END, p.pos) AS r FROM bpool p CROSS JOIN att a) WHERE r <= {p.k}),\n"
            f"cls AS (SELECT rep, attempt, count(DISTINCT label_idx) AS n_cls FROM cd GROUP BY rep, attempt),\n"
            f"ch AS (SELECT c.rep, min(c.attempt) AS attempt FROM cls c JOIN need n ON n.rep = c.rep "
            f"WHERE c.n_cls >= n.n_classes OR {p.k} < n.n_classes GROUP BY c.rep),\n"
            f"fit AS (SELECT d.rep, d.doc_id, d.label_idx AS y, d.attempt FROM cd d "
            f"JOIN ch ON ch.rep = d.rep AND ch.attempt = d.attempt)")


def vocab_fit_ctes(p: Params, ngc_max: int, ngw_max: int, char_cap: int, word_cap: int) -> str:
    """fdocs, grams, ft, tt, per, pex, voc (needs baseline_ctes)."""
    return (f"fdocs AS (SELECT d.doc_id, d.text FROM documents d WHERE d.doc_id IN "
            f"(SELECT doc_id FROM fit UNION SELECT doc_id FROM btest)),\n"
            f"{doc_grams_cte('fdocs', 'doc_id', ngc_max, ngw_max)},\n"
            f"ft AS (SELECT f.rep, g.doc_id, g.block, g.n, g.term, g.cnt FROM fit f JOIN grams g ON g.doc_id = f.doc_id),\n"
            f"tt AS (SELECT t.rep, g.doc_id, g.block, g.n, g.term, g.cnt FROM btest t JOIN grams g ON g.doc_id = t.doc_id),\n"
            f"per AS (SELECT rep, block, n, term, sum(cnt) AS cf, count(*) AS df FROM ft GROUP BY rep, block, n, term),\n"
            f"pex AS (SELECT per.*, CAST(unnest(generate_series(n, CASE WHEN block = 'char' THEN {ngc_max} "
            f"ELSE {ngw_max} END)) AS INTEGER) AS n_max FROM per),\n"
            f"voc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rep, block, n_max ORDER BY cf DESC, term) "
            f"AS r FROM pex) WHERE r <= CASE WHEN block = 'char' THEN {char_cap} ELSE {word_cap} END)")


def features_sql(p: Params, ngc: int, ngw: int, tfidf: bool) -> str:
    """Feature rows of one configuration over fit and test documents (needs vocab_fit_ctes)."""
    sel = (f"SELECT x.rep, x.doc_id, x.block, x.term, x.cnt, v.df FROM (SELECT * FROM ft UNION ALL SELECT * FROM tt) x "
           f"JOIN voc v ON v.rep = x.rep AND v.block = x.block AND v.term = x.term "
           f"AND v.n_max = CASE WHEN x.block = 'char' THEN {ngc} ELSE {ngw} END")
    if not tfidf:
        return f"SELECT rep, doc_id, block, term, round(CAST(cnt AS DOUBLE), 6) AS value FROM ({sel})"
    w = f"(1 + ln(cnt)) * (ln((1.0 + {p.k}) / (1.0 + df)) + 1)"
    return (f"SELECT rep, doc_id, block, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY rep, doc_id, block)), 6) "
            f"AS value FROM (SELECT *, {w} AS w FROM ({sel}))")


def perm_ctes(p: Params) -> str:
    """The keyed bijection with its rounds and walk, on the places of all tokens (``pvocab``: token, q)."""
    def network(x: str, s: str, i: str) -> str:
        left = f"{{'l': ({s}.l + {sql_hnum(p.seed, 'permute', 'r.rep', i, s + '.r')}) % z.a, 'r': {s}.r}}"
        right = f"{{'l': {s}.l, 'r': ({s}.r + {sql_hnum(p.seed, 'permute', 'r.rep', i, s + '.l')}) % z.b}}"
        end = f"list_reduce(range({ROUNDS}), lambda {s}, {i}: CASE WHEN {i} % 2 = 0 THEN {left} ELSE {right} END, {{'l': {x} // z.b, 'r': {x} % z.b}})"
        return f"(({end}).l * z.b + ({end}).r)"

    walk = f"list_reduce(range({WALK}), lambda x, w: CASE WHEN x >= z.n THEN {network('x', 's2', 'i2')} ELSE x END, {network('v.q', 's1', 'i1')})"
    return (f"pvocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS q FROM ({vocab_sql(PIECE_PATTERN)})),\n"
            f"z AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM (SELECT count(*) AS n FROM pvocab))),\n"
            f"pq AS (SELECT r.rep, v.token, {walk} AS q FROM pvocab v CROSS JOIN reps r CROSS JOIN z),\n"
            f"perm AS (SELECT pq.rep, pq.token, v.token AS new_token FROM pq JOIN pvocab v ON v.q = pq.q)")


def grid_values() -> str:
    from shotlab.operators.linear import CS, NGC, NGW, SOLVERS
    rows = [(c, s, a, b) for c in CS for s in SOLVERS for a in NGC for b in NGW]
    vals = ", ".join(f"({i}, CAST({c!r} AS DOUBLE), {q(s)}, {a}, {b})" for i, (c, s, a, b) in enumerate(rows))
    return f"SELECT * FROM (VALUES {vals}) v(grid_id, c, solver, ngc_max, ngw_max)"
