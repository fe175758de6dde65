"""Screening, labelling and classification of recruitment records on Spark."""
