"""Training-data operators: deduplication, tokenizers, classifiers, search and mixing over corpora."""
