"""Training-data operators: scoring, cleaning, deduplication and tokenisation of text corpora.

Nothing outside this folder imports it.  Each module holds one operator with a general interface;
``queries.py`` holds the thin ``opN_<name>`` queries over the standard tables.
"""
