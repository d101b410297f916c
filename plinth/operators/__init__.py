"""plinth.operators"""
