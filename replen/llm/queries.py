"""The registered queries of the text operators: each takes (spark, sf_dir) and covers the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replen.llm import exact, jaccard, langid, line_rules, lm_score, minhash, mixing, pieces, pii, quality, secrets, spelling, turns

#: The key of the pseudonyms in the registered query; users pass their own.
DEMO_KEY = "a key for the registered query"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    parser = langid.fit(docs.where(~held_out))
    return langid.predict(docs, parser).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)
    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", "text", *map(count, pii.KINDS))


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_rules.clean(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents"), exact.dealt_load())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fit_and_classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "copies", "taken")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.with_digests(secrets.scan(table(spark, sf_dir, "documents")))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), pieces.model_bytes(piece_model()))
    return pieces.with_digests(encoded)


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(table(spark, sf_dir, "conversations")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"), every=199)


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_langid": op2_langid,
    "op3_pii": op3_pii,
    "op4_line_rules": op4_line_rules,
    "op5_exact": op5_exact,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_lm_score": op8_lm_score,
    "op9_secrets": op9_secrets,
    "op10_pieces": op10_pieces,
    "op11_jaccard": op11_jaccard,
    "op12_turns": op12_turns,
    "op13_spelling": op13_spelling,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _op4() -> str:
    r = line_rules
    return f"""
        with d as (
            select row_number() over () as row_id, doc_id, coalesce(text, '') as text,
                   regexp_extract_all(coalesce(text, ''), '{_WORD}+') as words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines
            from documents),
        w as (
            select row_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] as window_text
            from (select row_id, words, unnest(range(1, len(words) - 1)) as i from d where len(words) >= 3)),
        f as (select row_id, i from w qualify count(*) over (partition by row_id, window_text) > 1),
        c as (select row_id, count(distinct p) as n from (select row_id, unnest([i, i + 1, i + 2]) as p from f) group by row_id),
        s as (
            select d.row_id, doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
                   len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
                   coalesce(list_sum(list_transform(list_filter(lines, lambda x:
                       (not regexp_matches(x, {_quoted(r.SENTENCE_END)}) and len(regexp_extract_all(x, '{_WORD}+')) > {r.MOST_HEADING})
                       or 10 * (length(x) - length(regexp_replace(x, '{r.SYMBOLS}', '', 'g'))) > length(x)
                       or regexp_matches(x, {_quoted(r.NAVIGATION)}) or regexp_matches(x, {_quoted(r.SHOUTING)})
                       or (regexp_matches(x, {_quoted(r.NOTICE)}) and length(x) <= {r.MOST_NOTICE})),
                       lambda x: length(regexp_replace(x, '{_SPACE}+', '', 'g')))), 0) as lost
            from d left join c using (row_id))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
               not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost <= 50 * word_chars as kept
        from s"""


def _op9() -> str:
    """The spans of every rule by walking the texts between its matches; no index is needed for the same result."""
    rules = [*secrets.BASE, *secrets.ADDED]
    each = " union all ".join(
        f"""select row_id, {i} as ord, '{r.kind}' as kind, {r.least} as least,
                   regexp_split_to_array(text, {_quoted(r.pattern)}) as around, regexp_extract_all(text, {_quoted(r.pattern)}, 0) as hits,
                   regexp_extract_all(text, {_quoted(r.pattern)}, {r.measured}) as measured
            from d where regexp_matches(text, {_quoted(r.pattern)})"""
        for i, r in enumerate(rules)
    )
    text = "kind || ':' || start_at || ':' || (start_at + size)"
    n = len(secrets.BASE)
    counts = ", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in secrets.BASE)
    return f"""
        with d as (select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents),
        e as ({each}),
        u as (select row_id, ord, kind, least, around, hits, measured, unnest(range(1, len(hits) + 1)) as i from e),
        s as (select row_id, ord, kind, length(hits[i]) as size,
                     (list_sum(list_transform(around[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::bigint as start_at
              from u where length(measured[i]) >= least)
        select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secrets.BASE)},
               sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
        from d left join (
            select row_id, {counts}, string_agg({text}, ',' order by start_at, ord) filter (where ord < {n}) as base,
                   string_agg({text}, ',' order by start_at, ord) as spans
            from s group by row_id) using (row_id)"""


def _links(width: int, more: str) -> str:
    """Components of documents whose sets of word shingles have a similarity of 0.85 or more, by all pairs that share a shingle."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(width))
    return f"""
        with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}+') as w from documents),
        s as (
            select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < {width} then [array_to_string(w, ' ')]
                                              else list_transform(range(1, len(w) - {width} + 2), lambda i: {shingle}) end) as s
            from d),
        x as (select doc_id, unnest(s) as g from s),
        n as (select a.doc_id as a, b.doc_id as b, count(*) as common from x a join x b using (g) where a.doc_id <> b.doc_id group by all),
        l as (
            select a, b from n join s p on p.doc_id = a join s q on q.doc_id = b
            where 100 * common >= 85 * (len(p.s) + len(q.s) - common)),
        reach as (select doc_id, doc_id as found from s union select doc_id, b from reach join l on found = a)
        select doc_id, any_value(len(s)) as n_shingles, min(found) as component_id{more} from reach join s using (doc_id) group by doc_id"""


def _crc32(text: str) -> str:
    """crc32 of an expression's UTF-8 bytes."""
    digit = lambda at: f"(instr('0123456789ABCDEF', substr(hex(encode({text})), {at}, 1)) - 1)"
    octets = f"list_transform(range(1, length(hex(encode({text}))), 2), lambda k: 16 * {digit('k')} + {digit('k + 1')})"
    step = "list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {octets}), lambda a, b: {step}), 4294967295::bigint)"


def _op12() -> str:
    """Costs and audits from the last turn to the first, for the four places in the grammar: 0 nothing yet, 1 after s, 2 after a pair, 3 an a is due."""
    key = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
    trimmed = "trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    edit = """
        (case when e.inserts = 0 then [] when e.inserts = 1 then [case when p.s = 3 then 'assistant:' else 'user:' end]
              else [case when p.s = 3 then 'assistant:' else 'user:' end, case when p.s = 3 then 'user:' else 'assistant:' end] end)"""
    return f"""
        with recursive h as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc32(key)} % 20 as hit from conversations),
        g as (
            select conv_id, turn, case when hit = 4 then 'user' else role end as role,
                   case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                   unnest(case hit when 0 then []::int[] when 3 then [0, 1] else [0] end) as copy
            from h),
        o as (
            select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, left(role, 1) as initial,
                   row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again, {trimmed} as bare
            from g),
        f as (
            select *, case when bare = '' then 'blank' when again then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
                   lag(initial) over (partition by conv_id order by i) || initial as pair
            from o),
        c as (
            select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
                   count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
                   count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal
            from f group by conv_id),
        places as (select unnest([0, 1, 2, 3]) as s),
        inserted as (select unnest([0, 1, 2]) as inserts),
        letters as (select unnest(['D', 'K', 'R']) as letter),
        best as (
            select conv_id, n as i, s, {{'cost': case s when 1 then 4 when 3 then 2 else 0 end, 'audit': case s when 1 then 'II' when 3 then 'I' else '' end,
                   'lines': case s when 1 then ['user:', 'assistant:'] when 3 then ['assistant:'] else [] end}} as b
            from c, places
            union all
            select p.conv_id, p.i - 1, p.s, min({{'cost': 2 * p.inserts + p.cost + q.b.cost, 'audit': repeat('I', p.inserts) || p.letter || q.b.audit,
                   'lines': list_concat(p.before, case when p.letter = 'D' then [] else [p.role || ':' || p.text] end, q.b.lines)}})
            from (
                select f.conv_id, f.i, p.s, e.inserts, l.letter, f.text, {edit} as before,
                       case e.inserts when 0 then p.s when 1 then (case p.s when 3 then 2 else 3 end) else (case p.s when 3 then 3 else 2 end) end as place,
                       case when l.letter = 'R' then (case place when 3 then 'assistant' else 'user' end) else f.role end as role,
                       case l.letter when 'D' then place when 'K' then (case when place = 0 and f.initial = 's' then 1 when place = 3 then 2 else 3 end) when 'R' then (case place when 3 then 2 else 3 end) end as next,
                       case l.letter when 'D' then 3 when 'K' then 0 else 2 end + case when l.letter <> 'D' and f.fault = 'truncated' then 1 else 0 end as cost
                from f, places p, inserted e, letters l
                where l.letter = 'D' or (f.fault not in ('blank', 'duplicate')
                      and (l.letter = 'R' or (place = 0 and f.initial = 's') or f.initial = case place when 3 then 'a' else 'u' end))) p
            join best q on q.conv_id is not distinct from p.conv_id and q.i = p.i and q.s = p.next
            group by all)
        select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
               coalesce(b.cost, 0) as cost, coalesce(b.audit, '') as audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) as repaired_sha256
        from (select distinct conv_id from conversations) a
        left join c on c.conv_id is not distinct from a.conv_id
        left join (select conv_id, b from best where i = 0 and s = 0) z on z.conv_id is not distinct from a.conv_id"""


def _op13() -> str:
    """Near words meet in what is left when one letter goes: two words less the same place, or a word less a letter and the other whole."""
    crc = _crc32("coalesce(doc_id::varchar, '') || ':' || run")
    return f"""
        with recursive r as (select doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]{{6,}}')) as run from documents),
        u as (select doc_id, run, count(*) as times, {crc} as h from r group by doc_id, run),
        m as (select times, case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from u),
        w as (select word, sum(times)::bigint as n from m where length(word) >= 6 group by word having sum(times) >= 5),
        cut as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
        pairs as (
            select a.word, a.n, b.word as near, b.n as near_n from cut a join cut b on a.i = b.i and a.rest = b.rest where a.word <> b.word
            union select a.word, a.n, w.word, w.n from cut a join w on a.rest = w.word
            union select w.word, w.n, a.word, a.n from cut a join w on a.rest = w.word),
        top as (select word, n, count(*) as n_near, max_by(near, (near_n, near = least_near)) as near, max(near_n) as near_n from (
                select *, min(near) over (partition by word, near_n) as least_near from pairs) group by word, n),
        forms as (select word, near as form, near_n as form_n from top where near_n >= 5 * n),
        chain as (select word, word as root, 0 as step from w union all select c.word, f.form, step + 1 from chain c join forms f on f.word = c.root)
        select w.word, form, root, w.n, coalesce(n_near, 0) as n_near, form_n
        from w left join top using (word) left join forms using (word) join (select word, max_by(root, step) as root from chain group by word) using (word)"""


ORACLE = {
    "op1_minhash": _links(5, ", component_id = doc_id as kept"),
    "op11_jaccard": _links(4, ""),
    "op12_turns": _op12(),
    "op13_spelling": _op13(),
    "op4_line_rules": _op4(),
    "op5_exact": f"""
        with t as (select doc_id, {_LOWER} as norm from documents)
        select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from t""",
    "op9_secrets": _op9(),
}
