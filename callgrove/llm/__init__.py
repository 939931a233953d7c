"""Training-data operators: ten numbered operators over document and page tables."""
