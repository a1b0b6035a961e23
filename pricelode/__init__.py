"""Offer-observation analytics and training-data operations as Spark DataFrame functions."""
