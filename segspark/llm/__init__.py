"""Training-data operators at corpus scale.

One module per operator; ``queries`` registers one ``opN_<name>`` query for
each. Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
