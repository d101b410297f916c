"""plinth.functions"""
