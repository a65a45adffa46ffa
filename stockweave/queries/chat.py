"""Chat routing over the conversation table."""

from __future__ import annotations

from stockweave.operators.chat import (
    canned_response,
    chat_to_search,
    classify_utterance,
    intent_counts,
    intent_shares,
)
from stockweave.operators.embed import hash_embed
from stockweave.queries.texts import SQL_CARD
from stockweave.queries.views import (
    DOCS,
    SQL_TOKEN,
    SQL_TURN_SCORES,
    document_vectors,
    table,
    user_turns,
)

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


SQL_CLASSES = r"""classified AS (
  SELECT conv_id, turn, trimmed AS text, CASE
    WHEN regexp_matches(trimmed, '(hi|hello|hey|greetings)', 'i') THEN 'greeting'
    WHEN regexp_matches(trimmed, '(bye|goodbye|thank you|thanks|cya)', 'i') THEN 'farewell'
    WHEN regexp_matches(trimmed, '(help|assist|support)', 'i') THEN 'help'
    ELSE 'search' END AS utterance_class
  FROM (SELECT *, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS trimmed
        FROM conversations WHERE role = 'user')
  WHERE trimmed <> '')"""


@query
def h1_classify_utterance(spark, d):
    return classify_utterance(user_turns(spark, d)).drop("role")


ORACLE["h1_classify_utterance"] = f"WITH {SQL_CLASSES} SELECT * FROM classified"


@query
def h1_classify_whole_words(spark, d):
    """All turns of all roles, with patterns that must match whole words."""
    return classify_utterance(table(spark, d, "conversations"), word_boundary=True).select(
        "conv_id", "turn", "utterance_class"
    )


ORACLE["h1_classify_whole_words"] = r"""
SELECT conv_id, turn, CASE
    WHEN regexp_matches(text, '\b(hi|hello|hey|greetings)\b', 'i') THEN 'greeting'
    WHEN regexp_matches(text, '\b(bye|goodbye|thank you|thanks|cya)\b', 'i') THEN 'farewell'
    WHEN regexp_matches(text, '\b(help|assist|support)\b', 'i') THEN 'help'
    ELSE 'search' END AS utterance_class
FROM conversations WHERE trim(text) <> ''"""


@query
def h2_canned_response(spark, d):
    classified = classify_utterance(user_turns(spark, d))
    return canned_response(classified, ["conv_id", "turn"]).select(
        "conv_id", "turn", "utterance_class", "reply"
    )


ORACLE["h2_canned_response"] = f"""
WITH {SQL_CLASSES},
picked AS (SELECT *, {SQL_TOKEN.format("'0|' || conv_id || '|' || turn")} % 3 AS n FROM classified)
SELECT conv_id, turn, utterance_class, CASE
  WHEN utterance_class = 'greeting' THEN CASE n
    WHEN 0 THEN 'Hello! How can I help you find products today?'
    WHEN 1 THEN 'Hi there! Looking for something specific?'
    ELSE 'Welcome! What kind of products are you interested in?' END
  WHEN utterance_class = 'farewell' THEN CASE n
    WHEN 0 THEN 'Thank you for chatting! Let me know if you need anything else.'
    WHEN 1 THEN 'Have a great day! Feel free to come back if you need more help.'
    ELSE 'Goodbye! Don''t hesitate to ask if you have more questions.' END
  WHEN utterance_class = 'help' THEN 'I can help you find products, check prices, and provide product information. What would you like to know?'
  END AS reply
FROM picked"""


@query
def h3_chat_to_search(spark, d):
    return chat_to_search(
        user_turns(spark, d), ["conv_id", "turn"], table(spark, d, "documents"),
        document_vectors(spark, d), DOCS, lambda df, c: hash_embed(df, c),
    )


ORACLE["h3_chat_to_search"] = f"""
WITH {SQL_CLASSES}, {SQL_TURN_SCORES},
cards AS (
  SELECT query_id, count(*) AS n, string_agg(
    {SQL_CARD} || '- length: ' || cast(n_chars AS varchar), chr(10) || chr(10) ORDER BY rank) AS body
  FROM (SELECT r.*, source AS name, text AS description, lang AS category, n_chars
        FROM ranks r JOIN documents ON cast(doc_id AS varchar) = r.id
        WHERE rank <= 5 AND NOT (score < 0.2))
  GROUP BY query_id)
SELECT c.query_id, cast(coalesce(n, 0) AS integer) AS n_results,
  CASE WHEN n IS NULL THEN 'No matching products found.' || chr(10) || chr(10)
       ELSE '### Found Products:' || chr(10) || chr(10) || body || chr(10) || chr(10) END
  || '---' || chr(10) || '*Search Query: "' || c.text || '"*' AS answer
FROM (SELECT conv_id || '|' || turn AS query_id, text FROM classified
      WHERE utterance_class = 'search') c
LEFT JOIN cards USING (query_id)"""


@query
def h4_intent_counts(spark, d):
    return intent_counts(classify_utterance(user_turns(spark, d)), ["conv_id"])


ORACLE["h4_intent_counts"] = f"""
WITH {SQL_CLASSES}
SELECT conv_id, utterance_class, count(*) AS n FROM classified GROUP BY conv_id, utterance_class"""


@query
def h4_intent_shares(spark, d):
    return intent_shares(classify_utterance(user_turns(spark, d)))


ORACLE["h4_intent_shares"] = f"""
WITH {SQL_CLASSES}
SELECT utterance_class, count(*) AS n,
       round(count(*) / (SELECT count(*) FROM classified), 6) AS share
FROM classified GROUP BY utterance_class"""
