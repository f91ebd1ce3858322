"""Caselake: a Spark-native engine for session evidence and corpus preparation."""
