"""Plain SQL twins of the registered queries, for an independent engine (DuckDB).

They restate each query in one statement over the given tables, without the
shortcuts of the Spark jobs, and are used to check results only.
"""

from __future__ import annotations

import math

from casedesk.functions import escalation as esc
from casedesk.functions import lexicons as lex
from casedesk.functions import rules
from casedesk.functions import text as tx
from casedesk.operators import evaluation, judging, reply_quality
from casedesk.plans.fixtures import JUDGED_FIELDS
from casedesk.plans.workspace import GOLDEN_SIZE, LEADING_BRANDS, PAIR_SAMPLE, POOL_SIZE
from casedesk.sources import tables

SPACE = r"\s\x0b\x85\pZ"
WORD = r"[\p{L}\p{N}_]"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def hit(text: str, terms) -> str:
    """Any of the terms, as one regular expression."""
    return f"regexp_matches({text}, {lit('|'.join(terms))})"


def word_hit(text: str, terms) -> str:
    pattern = "|".join(terms)
    edge = r"[^\p{L}\p{N}_]"
    return f"regexp_matches({text}, {lit(f'(^|{edge})({pattern})({edge}|$)')})"


def rule_case(text: str, lexicon) -> str:
    whens = " ".join(f"when {hit(text, terms)} then {lit(label)}" for label, terms in lexicon)
    return f"case {whens} else {lit(lex.OTHER)} end"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def clean(x: str) -> str:
    step = f"regexp_replace(lower(coalesce({x}, '')), '@{WORD}+', ' ', 'g')"
    step = f"regexp_replace({step}, 'http[^{SPACE}]+|www\\.[^{SPACE}]+', ' ', 'g')"
    return f"trim(regexp_replace({step}, '[{SPACE}]+', ' ', 'g'))"


def raw_text(context: str = "previous_context", message: str = "customer_message") -> str:
    return f"coalesce({context}, '') || ' ' || coalesce({message}, '')"


def merged(context: str = "previous_context", message: str = "customer_message") -> str:
    a, b = strip(context), strip(message)
    return (f"case when {a} <> '' and {b} <> '' then {a} || ' ' || {b} "
            f"when {b} <> '' then {b} else {a} end")


CLEAN_TEXT = f"{clean('previous_context')} || ' ' || {clean('customer_message')}"


def word_list(x: str, stop_words=()) -> str:
    words = f"regexp_extract_all(lower(coalesce({x}, '')), '{WORD}{{2,}}')"
    if not stop_words:
        return words
    return f"list_filter({words}, lambda w: w not in {in_list(stop_words)})"


def term_list(words: str) -> str:
    return (f"list_concat({words}, list_transform(range(1, len({words})), "
            f"lambda i: {words}[i] || ' ' || {words}[i + 1]))")


def numbered(values, index: str) -> str:
    whens = " ".join(f"when {i} then {lit(v)}" for i, v in enumerate(values))
    return f"case {index} {whens} end"


def _tweets() -> str:
    customer = " ".join(
        f"when {i} then {lit(v)}" + ("" if v == tables.SHORT_MESSAGE else " || text")
        for i, v in enumerate(tables.CUSTOMER_OPENINGS))
    brand = " ".join(
        f"when {i} then {lit(v)} || text" for i, v in enumerate(tables.BRAND_OPENINGS))
    turn_id = f"conv_id * {tables.ID_BLOCK} + turn * 2"
    return f"""
    turns as (
      select {turn_id} as tweet_id,
        case when role = 'user' then cast(conv_id + 100000 as varchar)
             else {numbered(tables.BRANDS, 'conv_id % 10')} end as author_id,
        role = 'user' as inbound,
        timestamp '2024-01-01 00:00:00' + (conv_id * 60 + turn) * interval '1' minute as created_at,
        case when role = 'user' then case (conv_id * 7 + turn * 3) % 16 {customer} end
             when conv_id % 17 <> 3 then case (conv_id + turn) % 4 {brand} end end as text,
        case when turn > 0 then {turn_id} - 2 end as in_response_to_tweet_id,
        turn
      from conversations where role in ('user', 'assistant')),
    tweets as (
      select tweet_id, author_id, inbound, created_at, text, in_response_to_tweet_id from turns
      union all
      select tweet_id + 1, author_id, inbound, created_at,
        {lit(tables.FOLLOW_UP)} || coalesce(text, ''), in_response_to_tweet_id
      from turns where not inbound and turn % 5 = 1)"""


def _joined(order: str, replies: str = "not b.inbound") -> str:
    return f"""select b.author_id as brand, c.tweet_id as customer_tweet_id,
        p.text as previous_context, c.text as customer_message, b.tweet_id as brand_tweet_id,
        b.text as brand_reply, c.created_at,
        row_number() over (partition by c.tweet_id order by b.tweet_id {order}) as place
      from tweets b join tweets c on b.in_response_to_tweet_id = c.tweet_id and c.inbound
      left join tweets p on p.tweet_id = c.in_response_to_tweet_id
      where {replies}"""


def _labels(source: str) -> str:
    text = "full_text"
    strong = " or ".join(
        f"(auto_intent = {lit(label)} and {hit(text, terms)})" for label, terms in lex.STRONG_TERMS)
    risky = (f"{hit(text, lex.PROPOSAL_RISK_TERMS)} or auto_intent in "
             f"{in_list(lex.PROPOSAL_RISK_INTENTS)} or (auto_intent = 'device_performance' and "
             f"{hit(text, lex.PROPOSAL_PERFORMANCE_TERMS)})")
    reasons = " ".join(f"when {lit(i)} then {lit(s)}" for i, s in rules.LABEL_REASONS)
    number = " ".join(f"when {lit(v)} then {i}" for i, v in enumerate(lex.INTENTS, 1))
    return f"""select * exclude (full_text),
        case auto_intent {number} end as auto_intent_number,
        case auto_intent {reasons} end
          || case when auto_escalate = 'yes' then {lit(rules.ESCALATED_REASON)} else '' end
          as auto_label_reason,
        'REVIEW' as review_status
      from (select *, case when {risky} then 'yes' else 'no' end as auto_escalate,
                   case when {strong} then 'high' else 'medium' end as confidence
            from (select *, {rule_case(text, lex.PROPOSAL_RULES)} as auto_intent
                  from (select *, lower({raw_text()}) as full_text from {source})))"""


def _labelled(source: str) -> str:
    return f"""select customer_tweet_id, previous_context, customer_message,
        auto_intent as intent, auto_escalate as escalate, auto_label_reason as label_reason,
        case when confidence = 'high' then 'HUMAN_REVIEWED' else 'PROPOSED' end as review_status
      from {source}"""


def _score(text: str, label: str) -> str:
    whens = " ".join(
        f"when {label} = {lit(name)} then "
        + " + ".join(f"cast(contains({text}, {lit(t)}) as integer)" for t in terms)
        for name, terms in lex.SILVER_RULES)
    return f"case {whens} else 0 end"


def _silver(source: str, intent: str = "predicted_intent", score: str = "prediction_confidence") -> str:
    return f"""select * exclude (clean_text, hits), hits / (hits + 2.0) as {score}
      from (select *, {_score('clean_text', intent)} as hits
            from (select *, {rule_case('clean_text', lex.SILVER_RULES)} as {intent}
                  from (select *, {CLEAN_TEXT} as clean_text from {source})))"""


def _escalation(source: str, intent: str, score: str) -> str:
    def settled(label, terms, a, b):
        return f"when topic = '{label}' then case when {hit('msg', terms)} then '{a}' else '{b}' end"

    chain = " ".join([
        f"when {word_hit('msg', lex.ESCALATION_HUMAN)} then 'human_request'",
        settled("payments_billing", lex.ESCALATION_FINANCE, "finance_risk", "finance_routine"),
        settled("account_icloud", lex.ESCALATION_ACCOUNT, "account_risk", "account_routine"),
        settled("hardware_repair", lex.ESCALATION_HARDWARE, "hardware_risk", "hardware_routine"),
        f"when {hit('msg', lex.ESCALATION_DEVICE)} then 'device_failure'",
        f"when {hit('msg', lex.ESCALATION_RESTART)} then 'restart_loop'",
        f"when topic = 'device_performance' and {hit('msg', lex.ESCALATION_WIDESPREAD)} "
        "then 'widespread_failure'",
        f"when topic = 'messaging_calls' and {hit('msg', lex.ESCALATION_CALLS)} "
        "then 'call_failure'",
        f"when {hit('msg', lex.ESCALATION_DATA_LOSS)} then 'data_loss'",
        f"when topic = 'other_unclear' and {score} < 0.30 then 'unclear'",
    ])
    sentences = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in esc.REASONS.items())
    quiet = "('finance_routine', 'account_routine', 'hardware_routine', 'first_line')"
    return f"""select * exclude (msg, topic), escalation_rule not in {quiet} as escalate_flag,
        case escalation_rule {sentences} end as escalation_reason
      from (select *, case {chain} else 'first_line' end as escalation_rule
            from (select *, lower({strip('customer_message')}) as msg,
                         lower({strip(intent)}) as topic from {source}))"""


def _vectors(name: str, source: str, key: str, text: str, stats: str, stop_words=(), damped=False) -> str:
    """Unit vectors of a text column under the vocabulary table ``stats``."""
    tf = "(1 + ln(tf))" if damped else "tf"
    return f"""
    {name}_tf as (select {key}, term, count(*) as tf from (
        select {key}, unnest({term_list('words')}) as term
        from (select {key}, {word_list(text, stop_words)} as words from {source}))
      group by all),
    {name}_w as (select {key}, t.term, {tf} * s.idf as w
      from {name}_tf t join {stats} s on t.term = s.term),
    {name} as (select {key}, term, w / sqrt(sum(w * w) over (partition by {key})) as weight
      from {name}_w)"""


def _stats(name: str, source: str, tf: str, max_df: float, limit: int | None) -> str:
    cut = f"order by cf desc, term limit {limit}" if limit else ""
    return f"""
    {name} as (select term, df, cf, ln((1 + n) / (1 + df)) + 1 as idf
      from (select term, count(*) as df, cast(sum(tf) as bigint) as cf from {tf} group by term),
           (select count(*) * 1.0 as n from {source})
      where df >= 2 and df <= {max_df} * n {cut})"""


def _index() -> str:
    text = raw_text()
    case_tf = f"""
    case_tf as (select customer_tweet_id as case_id, term, count(*) as tf from (
        select customer_tweet_id, unnest({term_list('words')}) as term
        from (select customer_tweet_id, {word_list(text, tx.STOP_WORDS)} as words from cases))
      group by all)"""
    weights = """
    case_vectors as (select case_id, term, w / sqrt(sum(w * w) over (partition by case_id)) as weight
      from (select case_id, t.term, tf * idf as w from case_tf t join vocab v on t.term = v.term))"""
    return ",".join([
        case_tf, _stats("vocab", "cases", "case_tf", 1.0, 2 ** 62), weights,
        _vectors("query_vectors", "inquiries", "customer_tweet_id", text, "vocab", tx.STOP_WORDS)])


def _flags(text: str, patterns) -> str:
    return ", ".join(f"{hit(text, terms)} as {name}" for name, terms in patterns)


def _drafts() -> str:
    return f"""
    top_cases as (select * from (
        select q.customer_tweet_id as query_id, c.case_id, round(sum(q.weight * c.weight), 6) as similarity,
          row_number() over (partition by q.customer_tweet_id
            order by round(sum(q.weight * c.weight), 6) desc, c.case_id) as rank
        from query_vectors q join case_vectors c on q.term = c.term
        group by q.customer_tweet_id, c.case_id
        having round(sum(q.weight * c.weight), 6) > 0)
      where rank <= 3),
    evidence as (select s.query_id as customer_tweet_id, s.rank, s.case_id, s.similarity,
        c.customer_message as case_message, c.brand_reply
      from top_cases s join cases c on s.case_id = c.customer_tweet_id),
    patterns as (select customer_tweet_id, n_cases, {_flags('replies', lex.EVIDENCE_PATTERNS)}
      from (select customer_tweet_id, count(*) as n_cases,
              lower(string_agg(brand_reply, ' ' order by rank)) as replies
            from evidence group by customer_tweet_id)),
    drafts as (select m.*, coalesce(p.n_cases, 0) as retrieved_case_count,
        case when p.n_cases is null then {lit(lex.REPLY_NO_EVIDENCE)} else
          {lit(lex.REPLY_GREETING)} || ' '
          || case when asks_for_device and asks_for_os then {lit(lex.REPLY_ASK_BOTH + ' ')}
                  when asks_for_device then {lit(lex.REPLY_ASK_DEVICE + ' ')}
                  when asks_for_os then {lit(lex.REPLY_ASK_OS + ' ')} else '' end
          || case when asks_for_dm then {lit(lex.REPLY_DM)}
                  when provides_steps then {lit(lex.REPLY_STEPS)}
                  else {lit(lex.REPLY_GENERIC)} end end as generated_reply
      from inquiries m left join patterns p using (customer_tweet_id)),
    answered as ({_escalation('(select d.*, s.predicted_intent, s.prediction_confidence as confidence '
                              'from drafts d join silver_open s using (customer_tweet_id))',
                              'predicted_intent', 'confidence')})"""


def _grounding() -> str:
    single = repr(math.log(1.5) + 1)
    words = f"len(list_filter(string_split_regex(reply, '[{SPACE}]+'), lambda w: w <> ''))"
    action = " + ".join(
        f"case when {name} then {weight} else 0.0 end"
        for name, weight in reply_quality.ACTION_WEIGHTS.items())
    terms = term_list("words")
    return f"""
    pair_texts as (select e.customer_tweet_id, e.case_id, d.generated_reply, e.brand_reply
      from evidence e join answered d using (customer_tweet_id)),
    pair_tf as (select customer_tweet_id, case_id, term,
        count(*) filter (side = 0) as a, count(*) filter (side = 1) as b
      from (select customer_tweet_id, case_id, 0 as side, unnest({terms}) as term
            from (select *, {word_list('generated_reply')} as words from pair_texts)
            union all
            select customer_tweet_id, case_id, 1 as side, unnest({terms}) as term
            from (select *, {word_list('brand_reply')} as words from pair_texts))
      group by all),
    pair_sums as (select customer_tweet_id, case_id, sum(a * b) as dot,
        sum(pow(a * idf, 2)) as na, sum(pow(b * idf, 2)) as nb
      from (select *, case when a > 0 and b > 0 then 1.0 else {single} end::double as idf from pair_tf)
      group by all),
    pair_cosine as (select p.customer_tweet_id, p.case_id,
        case when na > 0 and nb > 0 then dot / sqrt(na * nb) else 0.0 end as similarity
      from pair_texts p left join pair_sums s using (customer_tweet_id, case_id)),
    reply_flags as (select * exclude (reply), {_flags('reply', lex.REPLY_PATTERNS)},
        case when {words} = 0 then 0.0 when {words} between 8 and 80 then 1.0
             when {words} between 5 and 120 then 0.75 else 0.5 end::double as reply_length_score
      from (select *, lower({strip('generated_reply')}) as reply from answered)),
    scored as (select f.* exclude (escalate_flag, confidence), f.confidence as intent_confidence,
        f.escalate_flag as predicted_escalation,
        l.review_status as human_label_status, l.intent as expected_intent,
        l.escalate as expected_escalation,
        coalesce(b.best, 0.0) as historical_reply_similarity,
        case when b.best is null then 0.0 else round(least(
          {reply_quality.SIMILARITY_SHARE} * b.best + {reply_quality.ACTION_SHARE}
          * least(({action}) / {reply_quality.ACTION_TOTAL}, 1.0), 1.0), 4) end as grounding_score
      from reply_flags f
      left join (select customer_tweet_id, max(similarity) as best from pair_cosine
                 group by customer_tweet_id) b using (customer_tweet_id)
      left join labelled_open l using (customer_tweet_id))"""


def _verdict_field(name: str, kind: str) -> str:
    return f"cast(json_extract_string(body, '$.{name}') as {kind}) as {name}"


def _judge(messages: str = "asked", mark: str = "") -> str:
    """Responses and verdicts for a table of messages; ``mark`` sets their names apart."""
    number = " || ', ' || ".join(
        f"'\"{name}\": ' || case when (n + {i}) % 4 = 2 then '\"' else '' end"
        f" || cast(1 + (n + {i} + batch) % 5 as varchar)"
        f" || case (n + {i}) % 4 when 0 then '' when 1 then '.0' when 2 then '\"' else '.5' end"
        for i, name in enumerate(JUDGED_FIELDS))
    fields = ", ".join(
        [_verdict_field(n, "double") for n in JUDGED_FIELDS]
        + [_verdict_field("unsupported_claims", "boolean"),
           _verdict_field("major_issue", "varchar"), _verdict_field("reasoning", "varchar")])
    return f"""
    {mark}responses as (select customer_tweet_id, batch,
        case (n + batch) % 4
          when 0 then body
          when 1 then '```json' || chr(10) || body || chr(10) || '```'
          when 2 then 'My verdict is ' || body || ' and that is all.'
          else left(body, 40) end as raw
      from (select customer_tweet_id, batch, n,
              '{{' || {number} || ', "unsupported_claims": '
              || case when n % 3 = 0 then 'true' else 'false' end
              || ', "major_issue": "", "reasoning": "message of ' || cast(n as varchar)
              || ' characters"}}' as body
            from (select customer_tweet_id, length(customer_message) as n from {messages})
            cross join (values (0), (1)) b(batch))),
    {mark}verdicts as (select customer_tweet_id, batch, parse_ok, {fields}
      from (select customer_tweet_id, batch, coalesce(json_valid(body), false) as parse_ok,
              case when json_valid(body) then body end as body
            from (select customer_tweet_id, batch,
                    nullif(regexp_extract(raw, '(?s)\\{{.*\\}}'), '') as body from {mark}responses)))"""


def _reviews() -> str:
    return f"""
    decisions as (select customer_tweet_id, case n % 3 when 0 then 'y' when 1 then 'N' else 's' end as action,
        1 + n % 12 as intent_number, case when n % 2 = 0 then 'yes' else 'n' end as escalate,
        case when n % 5 = 0 then 'checked by hand' end as reason
      from (select customer_tweet_id, length(customer_message) as n from pairs)),
    reviewed as (select p.customer_tweet_id, p.auto_intent, p.auto_escalate,
        case when d.action = 'y' then p.auto_intent
             when d.action = 'N' then {numbered(('',) + lex.INTENTS, 'd.intent_number')}
             else '' end as intent,
        case when d.action = 's' then '' when d.escalate = 'yes' then 'yes' else 'no' end as escalate,
        case when d.action = 's' then ''
             when d.reason is not null then d.reason
             else 'Human-reviewed as ' || case when d.action = 'y' then p.auto_intent
               else {numbered(('',) + lex.INTENTS, 'd.intent_number')} end end as label_reason,
        case when d.action = 's' then 'REVIEW' else 'reviewed' end as review_status
      from proposed p join decisions d using (customer_tweet_id))"""


def base() -> str:
    """The steps all checks share."""
    golden_order = "md5(cast(customer_tweet_id as varchar) || ':42'), customer_tweet_id"
    return "with " + ",".join([
        _tweets(),
        f"""
    pairs as (select * exclude (place) from ({_joined('')})
      where place = 1 and customer_message is not null and brand_reply is not null)""",
        """
    open_messages as (select c.tweet_id as customer_tweet_id, p.text as previous_context,
        c.text as customer_message, c.created_at
      from tweets c left join tweets p on p.tweet_id = c.in_response_to_tweet_id
      where c.inbound and c.text is not null
        and not exists (select 1 from pairs x where x.customer_tweet_id = c.tweet_id))""",
        f"""
    golden as (select customer_tweet_id, coalesce(previous_context, '') as previous_context,
        customer_message, brand_reply from pairs order by {golden_order} limit {GOLDEN_SIZE})""",
        """
    asked as (select customer_tweet_id, previous_context, customer_message from golden)""",
        """
    inquiries as (select customer_tweet_id, previous_context, customer_message from open_messages
      union all select * from asked)""",
        """
    train as (select * from pairs where customer_tweet_id not in (select customer_tweet_id from golden))""",
        f"""
    proposed as ({_labels('pairs')})""",
        f"""
    proposed_open as ({_labels('asked')})""",
        f"""
    labelled_pairs as ({_labelled('proposed')})""",
        f"""
    labelled_open as ({_labelled('proposed_open')})""",
        f"""
    silver_open as ({_silver('asked')})""",
        f"""
    silver_train as (select customer_tweet_id, coalesce(previous_context, '') as previous_context,
        customer_message, brand_reply, created_at, {rule_case('clean_text', lex.SILVER_RULES)} as intent
      from (select *, {CLEAN_TEXT} as clean_text from train)
      where length({strip('customer_message')}) >= 5)""",
        f"""
    results as ({_escalation(f'''(select * exclude (escalate), lower({strip('escalate')}) in
          ('yes', 'true', '1') as actual_escalation,
        (select intent from labelled_pairs group by intent order by count(*) desc, intent limit 1)
          as majority_prediction,
        {rule_case('lower(' + merged() + ')', lex.BASELINE_RULES)} as keyword_prediction
        from ({_silver('labelled_pairs')}))''', 'predicted_intent', 'prediction_confidence')})""",
        """
    cases as (select * from pairs where customer_tweet_id not in
      (select customer_tweet_id from golden))""",
        _index(), _drafts(), _grounding(), _judge(), _judge("pairs", "pair_"), _reviews(),
    ])


def _report(actual: str, predicted: str, labels=()) -> str:
    fixed = "".join(f" union select {lit(v)}" for v in labels)
    return f""", cells as (select {actual} as actual, {predicted} as predicted from results),
    labels as (select actual as label from cells union select predicted from cells{fixed}),
    counts as (select label,
        (select count(*) from cells where actual = label and predicted = label) as hits,
        (select count(*) from cells where actual = label) as support,
        (select count(*) from cells where predicted = label) as guessed from labels),
    scores as (select label, support, hits,
        case when guessed = 0 then 0.0 else hits / guessed end as precision,
        case when support = 0 then 0.0 else hits / support end as recall,
        case when guessed + support = 0 then 0.0 else 2.0 * hits / (guessed + support) end as f1
      from counts)
    select label, round(precision, 6) as precision, round(recall, 6) as recall,
      round(f1, 6) as f1_score, support from scores
    union all select 'accuracy', null, null, round(sum(hits) / sum(support), 6),
      cast(sum(support) as bigint) from scores
    union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6),
      round(avg(f1), 6), cast(sum(support) as bigint) from scores
    union all select 'weighted avg', round(sum(precision * support) / sum(support), 6),
      round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
      cast(sum(support) as bigint) from scores"""


def _union(parts) -> str:
    return " union all ".join(parts)


def _quality_means() -> str:
    return "count(*) as n, " + ", ".join(
        f"round(avg(cast({c} as double)), 6) as {c}" for c in reply_quality.QUALITY_COLUMNS)


PAIR_COLUMNS = ("brand", "customer_tweet_id", "previous_context", "customer_message",
                "brand_tweet_id", "brand_reply", "created_at")
TWEET_COLUMNS = ("tweet_id", "author_id", "inbound", "created_at", "text",
                 "in_response_to_tweet_id")


def _prompt() -> str:
    cases = """(select string_agg('--- Case ' || cast(rank as varchar) || ' ---' || chr(10)
        || 'Customer: ' || case_message || chr(10) || 'Reply: ' || brand_reply, chr(10) order by rank)
      from evidence e where e.customer_tweet_id = a.customer_tweet_id)"""
    sections = [("MESSAGE", "customer_message"), ("CONTEXT", "previous_context"),
                ("INTENT", "predicted_intent"), ("REPLY", "generated_reply"), ("CASES", cases)]
    text = " || ".join(f"chr(10) || chr(10) || '{name}:' || chr(10) || coalesce({value}, '')"
                       for name, value in sections)
    return (f"{lit(judging.RUBRIC)} || {text} || chr(10) || chr(10) || "
            f"'Answer in this form:' || chr(10) || {lit(judging.ANSWER_FORM)}")


def oracle_sql() -> dict[str, str]:
    common = base()
    verdict_columns = [*JUDGED_FIELDS, "unsupported_claims", "major_issue", "reasoning"]
    verdicts = ", ".join(verdict_columns)
    feature_stats = ",".join([
        f"""
    train_docs as (select customer_tweet_id, 'Previous context: ' || previous_context || chr(10)
        || 'Customer message: ' || customer_message as doc from silver_train),
    train_tf as (select customer_tweet_id, term, count(*) as tf from (
        select customer_tweet_id, unnest({term_list('words')}) as term
        from (select customer_tweet_id, {word_list('doc')} as words from train_docs)) group by all)""",
        _stats("train_vocab", "train_docs", "train_tf", 0.95, None),
        _vectors("train_vectors", "train_docs", "customer_tweet_id", "doc", "train_vocab",
                 damped=True)])
    themes_of = " , ".join(
        f"case when {hit('lowered', terms)} then {lit(name)} end" for name, terms in lex.THEMES)
    bodies = {
        "brand_tweets": "select * from tweets where not inbound",
        "brand_counts": "select author_id as brand_id, count(*) as support_tweets from tweets "
                        "where not inbound group by 1",
        "top_brands": "select author_id as brand_id, count(*) as support_tweets from tweets "
                      "where not inbound group by 1 order by 2 desc, 1 limit 30",
        "dataset_profile": _union(
            f"select '{c}' as column_name, count(*) as n_rows, count({c}) as n_non_null from tweets"
            for c in TWEET_COLUMNS),
        "null_counts": _union(
            f"select '{c}' as column_name, count(*) - count({c}) as n_null from pairs"
            for c in PAIR_COLUMNS),
        "reply_pairs": "select * from pairs",
        "conversation_pairs": f"""select * exclude (place, previous_context) from ({_joined('desc')})
            where place = 1""",
        "answered_customers": """select * from tweets where inbound and tweet_id in
            (select in_response_to_tweet_id from tweets where not inbound)""",
        "brand_pairs": f"""select * exclude (place) from ({_joined('', "b.author_id = 'AcmeHelp'")})
            where place = 1 and customer_message is not null and brand_reply is not null""",
        "brand_customers": """select * from tweets where inbound and tweet_id in
            (select in_response_to_tweet_id from tweets where author_id = 'AcmeHelp')""",
        "answered_flags": """select t.tweet_id, exists (select 1 from tweets b where not b.inbound
            and b.in_response_to_tweet_id = t.tweet_id) as has_brand_response
            from tweets t where inbound""",
        "open_messages": "select * from open_messages",
        "stage_counts": _union([
            "select 'tweets' as stage, count(*) as n from tweets",
            "select 'brand_tweets', count(*) from tweets where not inbound",
            "select 'interactions', count(*) from tweets b join tweets c on "
            "b.in_response_to_tweet_id = c.tweet_id where not b.inbound and c.inbound",
            "select 'pairs', count(*) from pairs", "select 'golden', count(*) from golden",
            "select 'train', count(*) from train",
            "select 'silver_train', count(*) from silver_train"]),
        "pair_sample": "select * from pairs order by md5(cast(customer_tweet_id as varchar) || ':42'), "
                       f"customer_tweet_id limit {PAIR_SAMPLE}",
        "golden_set": "select *, '' as intent, '' as escalate, '' as label_reason from golden",
        "train_split": "select * from train",
        "clean_messages": f"""select customer_tweet_id, {clean('previous_context')} as clean_context,
            {clean('customer_message')} as clean_message from pairs""",
        "evaluation_text": f"""select customer_tweet_id, {CLEAN_TEXT} as cleaned, {raw_text()} as raw,
            'Previous context: ' || coalesce(previous_context, '') || chr(10) || 'Customer message: '
            || customer_message as template, {merged()} as merged from pairs""",
        "silver_intent": f"""select customer_tweet_id,
            {rule_case('t', lex.SILVER_RULES)} as intent
            from (select customer_tweet_id, {CLEAN_TEXT} as t from pairs)""",
        "silver_train": "select * from silver_train",
        "auto_label": "select * exclude (brand, brand_tweet_id) from proposed",
        "keyword_baseline": f"""select customer_tweet_id,
            {rule_case('lower(' + merged() + ')', lex.BASELINE_RULES)} as keyword_prediction
            from pairs""",
        "escalation_decisions": """select customer_tweet_id, predicted_intent as intent,
            round(prediction_confidence, 6) as confidence, escalation_rule,
            escalate_flag as escalate, escalation_reason from results""",
        "intent_distribution": f"""select d.intent, count(s.intent) as n from
            (select unnest([{', '.join(lit(i) for i in lex.INTENTS)}]) as intent) d
            left join silver_train s using (intent) group by 1""",
        "label_distribution": _union(
            f"select '{c}' as label_column, {c} as label, count(*) as n from proposed group by 2"
            for c in ("auto_intent", "auto_escalate", "confidence")),
        "message_length_stats": """select count(*) as n, round(avg(x), 6) as mean,
            round(stddev_samp(x), 6) as std, min(x) as min, quantile_cont(x, 0.25) as p25,
            quantile_cont(x, 0.5) as p50, quantile_cont(x, 0.75) as p75, max(x) as max
            from (select length(customer_message) as x from pairs)""",
        "top_keywords": f"""select word, count(*) as n from (select unnest(string_split_regex(
              regexp_replace(regexp_replace(lower(customer_message), 'http[^{SPACE}]+', ' ', 'g'),
              '[^a-z\\s]', ' ', 'g'), '\\s+')) as word from pairs)
            where length(word) > 2 and word not in {in_list(lex.KEYWORD_STOPWORDS)}
            group by 1 order by 2 desc, 1 limit 100""",
        "theme_counts": _union(
            f"select '{name}' as theme, count(*) as n from pairs where "
            f"{hit('lower(customer_message)', terms)}" for name, terms in lex.THEMES),
        "theme_examples": f"""select theme, example, customer_tweet_id, customer_message, brand_reply
            from (select *, row_number() over (partition by theme order by customer_tweet_id) as example
              from (select customer_tweet_id, customer_message, brand_reply, unnest([{themes_of}]) as theme
                    from (select *, lower(customer_message) as lowered from pairs))
              where theme is not null) where example <= 5""",
        "term_stats": "select term, df, cf, round(idf, 6) as idf from vocab",
        "case_index": "select case_id, term, round(weight, 6) as weight from case_vectors",
        "similar_cases": "select query_id, case_id, similarity, rank from top_cases",
        "reply_patterns": "select * exclude (n_cases) from patterns",
        "draft_replies": "select customer_tweet_id, generated_reply, retrieved_case_count from drafts",
        "reply_flags": f"""select customer_tweet_id, {', '.join(reply_quality.FLAG_COLUMNS)},
            reply_length_score from reply_flags""",
        "reply_similarity": "select customer_tweet_id, case_id, round(similarity, 6) as similarity "
                            "from pair_cosine",
        "grounding_scores": """select customer_tweet_id, grounding_score,
            round(historical_reply_similarity, 6) as historical_reply_similarity from scored""",
        "judge_queue": f"""select {', '.join(c for c in reply_quality.JUDGE_QUEUE_COLUMNS
                                             if c != 'historical_reply_similarity')},
            round(historical_reply_similarity, 6) as historical_reply_similarity from scored""",
        "reply_quality_summary": f"select {_quality_means()} from scored",
        "reply_quality_by_status":
            f"select human_label_status, {_quality_means()} from scored group by 1",
        "evaluation_results": """select customer_tweet_id, previous_context, customer_message, intent,
            label_reason, review_status, predicted_intent,
            round(prediction_confidence, 6) as prediction_confidence, keyword_prediction,
            majority_prediction, actual_escalation, escalate_flag as predicted_escalation,
            escalation_reason from results""",
        "label_status": """select count(*) as n_total,
            count(*) filter (review_status = 'HUMAN_REVIEWED') as n_human,
            count(*) filter (review_status = 'PROPOSED') as n_proposed from labelled_pairs""",
        "majority_baseline": """select intent as majority_class, count(*) as n,
            round(count(*) / (select count(*) from labelled_pairs), 6) as accuracy
            from labelled_pairs group by 1 order by 2 desc, 1 limit 1""",
        "accuracy_comparison": """select round(a, 6) as majority_accuracy, round(k, 6) as keyword_accuracy,
            round(m, 6) as model_accuracy, round((m - a) * 100, 4) as gain_vs_majority,
            round((m - k) * 100, 4) as gain_vs_keyword from (
            select avg(cast(intent = majority_prediction as integer)) as a,
              avg(cast(intent = keyword_prediction as integer)) as k,
              avg(cast(intent = predicted_intent as integer)) as m from results)""",
        "classification_report": _report("intent", "predicted_intent"),
        "escalation_report": _report(
            "case when actual_escalation then 'yes' else 'no' end",
            "case when escalate_flag then 'yes' else 'no' end", ("no", "yes")),
        "confusion_matrix": "select intent as actual, predicted_intent as predicted, count(*) as n "
                            "from results group by 1, 2",
        "mistakes": """select customer_tweet_id, customer_message, previous_context, intent,
            predicted_intent, round(prediction_confidence, 6) as prediction_confidence
            from results where intent <> predicted_intent""",
        "confidence_stats": """select count(*) as n, round(avg(c), 6) as mean,
            round(quantile_cont(c, 0.5), 6) as median, min(c) as min, max(c) as max
            from (select round(prediction_confidence, 6) as c from results)""",
        "confidence_coverage": _union(
            f"select {t}::double as threshold, round(avg(cast(prediction_confidence >= {t} as integer)), 6) "
            "as coverage from results" for t in evaluation.COVERAGE_LEVELS),
        "class_weights": """select intent, count(*) as n, round((select count(*) from silver_train)
            / ((select count(distinct intent) from silver_train) * count(*)), 6) as weight
            from silver_train group by 1""",
        "tfidf_features": "," + feature_stats + """
            select customer_tweet_id, term, round(weight, 6) as weight from train_vectors""",
        "judge_requests": f"""select customer_tweet_id, prompt, json_object('contents',
            [json_object('parts', [json_object('text', prompt)])], 'generationConfig',
            json_object('temperature', 0, 'responseMimeType', 'application/json'))::varchar as payload
            from (select customer_tweet_id, {_prompt()} as prompt from answered a)""",
        "judge_parsed": f"select customer_tweet_id, batch, parse_ok, {verdicts} from verdicts",
        "judge_pending": """select customer_tweet_id, customer_message, intent from labelled_open
            where customer_tweet_id not in
            (select customer_tweet_id from verdicts where batch = 0 and parse_ok)""",
        "judge_latest": f"""select customer_tweet_id, batch, parse_ok, {verdicts} from (select *,
            row_number() over (partition by customer_tweet_id order by batch desc) as place
            from verdicts) where place = 1""",
        "judge_merged": f"""select customer_tweet_id, {verdicts} from (select *,
            row_number() over (partition by customer_tweet_id order by batch desc) as place
            from verdicts where parse_ok) where place = 1""",
        "judge_results": f"""select a.customer_tweet_id, a.customer_message, a.predicted_intent as intent,
            round(a.confidence, 6) as confidence, a.generated_reply, a.escalate_flag as escalate,
            a.escalation_reason, {verdicts}, l.review_status as human_reviewed,
            l.intent as human_intent, l.escalate as human_escalate
            from answered a join (select * from verdicts where batch = 0 and parse_ok) v
              using (customer_tweet_id) left join labelled_open l using (customer_tweet_id)""",
        "judge_summary": """select count(*) as n_judged, round(avg(overall), 6) as mean_overall,
            round(avg(cast(overall >= 4 as integer)), 6) as share_high from verdicts
            where batch = 0 and parse_ok and overall > 0""",
        "apply_reviews": "select * from reviewed",
        "review_progress": """select count(*) filter (review_status = 'reviewed') as n_reviewed,
            count(*) as n_total from reviewed""",
        "stream_triage": f"""select customer_tweet_id, intent, round(confidence, 6) as confidence,
            escalate_flag as escalate, escalation_rule from ({_escalation('(' + _silver(
                "(select t.tweet_id as customer_tweet_id, p.text as previous_context, t.text as customer_message "
                "from tweets t left join tweets p on p.tweet_id = t.in_response_to_tweet_id "
                "where t.inbound and t.text is not null)", 'intent', 'confidence') + ')',
                'intent', 'confidence')})""",
        "stream_verdicts": f"""select customer_tweet_id, batch, parse_ok, {verdicts} from (select *,
            row_number() over (partition by customer_tweet_id order by batch desc) as place
            from pair_verdicts) where place = 1""",
    }
    bodies |= {
        "rule_table_labels": f"""select customer_tweet_id, {rule_case(CLEAN_TEXT, lex.SILVER_RULES)} as silver,
            {rule_case('lower(' + raw_text() + ')', lex.PROPOSAL_RULES)} as proposal,
            {rule_case('lower(' + merged() + ')', lex.BASELINE_RULES)} as baseline from pairs""",
        "rule_table_themes": bodies["theme_counts"],
        "label_cube": """select brand, auto_intent as intent, confidence, count(*) as n,
            cast(count(*) filter (auto_escalate = 'yes') as bigint) as n_escalated,
            cast(grouping_id(brand, auto_intent, confidence) as bigint) as grouping
            from proposed group by grouping sets (
              (brand, auto_intent, confidence), (brand, auto_intent), (brand, confidence), (brand), ())""",
        "leading_brands": "select author_id as brand_id, count(*) as support_tweets from tweets "
                          f"where not inbound group by 1 order by 2 desc, 1 limit {LEADING_BRANDS}",
        "evaluation_pool": "select * from pairs order by md5(cast(customer_tweet_id as varchar) || "
                           f"':42'), customer_tweet_id limit {POOL_SIZE}",
        "sketch_errors": """select inbound, count(*) as n, true as lengths_close, true as authors_close
            from tweets where text is not null group by inbound""",
        "segment_term_stats": bodies["term_stats"],
        "judge_variants": bodies["judge_parsed"],
        "csv_tweets": """select * replace (text || chr(10) || '"as written", once more' || chr(10)
            as text) from tweets""",
    }
    bodies["stream_context"] = bodies["stream_triage"]
    return {
        name: common + (body if body.startswith(",") else "\n    " + body)
        for name, body in bodies.items()
    }
