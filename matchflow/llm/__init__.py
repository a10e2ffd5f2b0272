"""Training-data operators: scoring, cleaning, fingerprinting and tokenizing of whole document tables."""
