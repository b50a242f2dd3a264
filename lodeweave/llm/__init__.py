"""Operators for large text corpora: sharding, toxicity, top-k search, WARC, chat formatting,
decontamination, SentencePiece coding, language-model scoring, secret scans, n-gram Jaccard joins,
whitening, mixing and phrase collocations.

Nothing else in the library imports this subpackage.
"""
