"""plinth.sources"""
