"""Stand-in tables: the shapes of run data, derived from the given tables.

The SQL keeps to expressions that Spark and DuckDB read alike.
"""

from runsift.plans.registry import standin

# One generated run per event: user = question pair, event type = condition.
standin("runs", """
SELECT event_id AS run_id, user_id AS pair_id, event_type AS condition,
  CASE user_id % 4 WHEN 0 THEN 'linear' WHEN 1 THEN 'ratio' WHEN 2 THEN 'word' ELSE 'table' END AS category,
  CASE WHEN value < 20 THEN 'Q' WHEN value < 60 THEN 'QSTAR' WHEN value < 110 THEN 'AMBIGUOUS' ELSE 'OTHER' END AS final_branch,
  CASE WHEN event_id % 3 = 0 THEN 'Q' WHEN event_id % 3 = 1 THEN 'QSTAR' ELSE 'OTHER' END AS trace_branch,
  event_id % 7 <> 0 AS eligible,
  CASE WHEN event_id % 13 = 0 THEN 'missing_answer_boundary' ELSE 'ok' END AS parse_status,
  CASE WHEN event_id % 17 = 0 THEN 'error' ELSE 'generated' END AS execution_status,
  event_id % 19 = 0 AS truncated,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('edit_', CAST(event_id % 5 AS STRING)) END AS edit_type,
  CASE event_id % 3 WHEN 0 THEN '0.2' WHEN 1 THEN '0.7' ELSE '1.0' END AS temperature,
  CAST(round(value * 100) AS BIGINT) - 3500 AS margin,
  ts
FROM events
""")

# One clean control per order.
standin("controls", """
SELECT o_orderkey AS prompt_id, o_custkey AS pair_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'original' ELSE 'counterfactual' END AS prompt_role,
  o_orderpriority AS category, o_orderstatus <> 'P' AS final_correct, o_orderstatus AS status,
  CAST(round(o_totalprice * 100) AS BIGINT) AS cents
FROM orders
""")

# Masked continuations of a line item.
standin("masks", """
SELECT l_orderkey AS parent_id, l_linenumber AS line_no,
  CASE l_linenumber % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'question' WHEN 2 THEN 'cot' ELSE 'question_and_cot' END AS mask,
  CASE l_returnflag WHEN 'A' THEN 'Q' WHEN 'R' THEN 'QSTAR' ELSE 'OTHER' END AS masked_branch,
  CASE l_linestatus WHEN 'O' THEN 'Q' ELSE 'QSTAR' END AS natural_branch,
  CAST(l_quantity AS BIGINT) AS masked_position_count
FROM lineitem
""")

# Word-length lists as token ids, one per conversation turn.
standin("token_rows", """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS row_id, conv_id, turn, role, text, split(text, ' ') AS words
FROM conversations
""")

# One question pair with a trace and a final answer per order: two equations,
# the second one changed in Q*; the answer wording rotates over six forms.
standin("pairs", """
SELECT o_orderkey AS pair_id, o_orderpriority AS category, o_orderstatus AS status,
  concat('Solve the system.', chr(10), a, 'x + ', b, 'y = ', c, chr(10), '1x - 1y = ', d, chr(10)) AS original_question,
  concat('Solve the system.', chr(10), a, 'x + ', b, 'y = ', c, chr(10), '1x - 1y = ', e, chr(10)) AS counterfactual_question,
  concat('(', d, ', ', b, '/', a, ')') AS original_answer, concat('(', e, ', ', b, '/', a, ')') AS counterfactual_answer,
  a, b, c, d, e,
  CASE o_orderkey % 6
    WHEN 0 THEN concat('Therefore x = ', d, ' and y = ', b, '/', a, '. The prompt states it.')
    WHEN 1 THEN concat('So it is (', e, ', ', b, '/', a, ') and nothing else')
    WHEN 2 THEN concat('x = ', d, ', y = ', b, '/', a, ' at first; however the prompt differs. Final answer: x = ', e, ', y = ', b, '/', a)
    WHEN 3 THEN concat('I solve x - y = ', e, ' and then re-check x - y = ', d, ' against the scratchpad, a mismatch')
    WHEN 4 THEN concat('Take ', chr(92), 'frac{', b, '}{', a, '} of $', d, '$ or 1,', 100 + a, '.5, wait')
    ELSE 'No value was found.' END AS final_answer,
  concat('Step 1: x - y = ', e, '.', chr(10), chr(10), 'So x is ', e, '. Check it: ', b, '/', a, chr(10), '2. **Final Review', chr(10), 'Done') AS thought
FROM (SELECT *, CAST(o_custkey % 7 + 2 AS STRING) AS a0, CAST(o_orderkey % 9 + 1 AS STRING) AS b, CAST(o_custkey % 7 + 2 AS BIGINT) AS a,
  CAST(o_orderkey % 50 + 3 AS STRING) AS c, CAST(o_custkey % 90 + 10 AS STRING) AS d, CAST(o_custkey % 90 + 10 + 1 + o_orderkey % 3 AS STRING) AS e FROM orders) o
""")
