"""plinth.streaming"""
